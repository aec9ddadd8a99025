"""Continuous prompt scanning (the B1 scan on a stream).

The governance scan and prompt pricing are stateless Column expressions, so
the same operators run unchanged on a ``readStream`` frame: each micro-batch
of landed log files is priced and scored and appended to the scored table.
Progress and exactly-once file output are tracked in a checkpoint folder that
must live on shared storage (by default under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.risk import with_risk
from ..operators.usage import rate_table, with_prompt_cost


def scored_stream(spark: SparkSession, source_dir: str) -> DataFrame:
    """Stream of landed usage-log parquet files, priced (P10) and scored."""
    raw_schema = schemas.USAGE_LOGS
    keep = [f for f in raw_schema.fields if f.name not in ("cost_usd", "risk_flag", "risk_score", "risk_level")]
    from pyspark.sql import types as T
    src = spark.readStream.schema(T.StructType(keep)).parquet(source_dir)
    priced = with_prompt_cost(src, rate_table(spark))
    return with_risk(priced, types=True).withColumn("pii_types", F.array_join("pii_types", "|"))


def start_scan(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
               available_now: bool = True) -> StreamingQuery:
    """Start the scan; ``available_now`` processes what has landed and stops. Each stream needs a checkpoint folder of
    its own."""
    w = (scored_stream(spark, source_dir).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
