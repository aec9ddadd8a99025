"""Published tables: a write that dies, concurrent writers, partitions that keep their files, keyed updates."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roilens.sources.ingest import quarantine, read_landed
from roilens.sources.tables import load
from roilens.sources.versions import VersionConflict, VersionedTable
from roilens import schemas


def _rows(spark, n=60):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 4 < 3, F.concat(F.lit("p/ "), F.col("id") % 4)).alias("p"),
                                 (F.col("id") * 1.5).alias("v"), F.lit("old").alias("t"))


def _files(table):
    return {f: Path(table.path, "data", f).stat().st_mtime_ns for f in
            (str(p.relative_to(f"{table.path}/data")) for p in Path(table.path, "data").rglob("*.parquet"))}


def test_a_write_that_dies_leaves_the_last_version(spark, scratch):
    table = VersionedTable(spark, f"{scratch}/t")
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(_rows(spark))
    broken = _rows(spark).withColumn("v", F.when(F.col("k") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken.repartition(4))
    assert table.current()["version"] == 1 and table.read().count() == 60
    table.replace(table.read().where("k < 10"))  # a table may be rewritten from itself
    assert table.read().count() == 10
    assert table.vacuum() >= 1 and table.read().count() == 10 and len(table._numbers()) == 1


def test_two_writers_of_one_version(spark, scratch, monkeypatch):
    table = VersionedTable(spark, f"{scratch}/t")
    table.replace(_rows(spark))
    late = VersionedTable(spark, f"{scratch}/t")
    monkeypatch.setattr(late, "_next", lambda: 2)
    table.replace(_rows(spark, 5))
    with pytest.raises(VersionConflict):
        late.replace(_rows(spark, 7))
    assert table.read().count() == 5


def test_partitions_keep_their_files(spark, scratch):
    table = VersionedTable(spark, f"{scratch}/t")
    table.replace(_rows(spark), "p")
    before = _files(table)
    table.replace_partitions(_rows(spark, 8).withColumn("t", F.lit("new")), ["p/ 1"])
    table.replace_partitions(_rows(spark).limit(0), ["p/ 2"])  # cleared
    got = {(r["p"], r["t"]): r["n"] for r in table.read().groupBy("p", "t").agg(F.count("*").alias("n")).collect()}
    assert got == {("p/ 0", "old"): 15, ("p/ 1", "new"): 2, (None, "old"): 15}
    assert all(_files(table)[f] == at for f, at in before.items())
    assert table.read(["p/ 1", None]).count() == 17 and table.read(["nothing"]).count() == 0
    table.replace_partitions(_rows(spark, 4).limit(0), [None])
    assert table.read().where("p is null").count() == 0


def test_update_rewrites_only_partitions_with_updated_keys(spark, scratch):
    table = VersionedTable(spark, f"{scratch}/t")
    table.replace(_rows(spark), "p")
    folders = table.current()["folders"]
    updates = spark.createDataFrame([(5, 500.0, "new"), (9, None, "new"), (999, 1.0, "new")], "k long, v double, t string")
    table.update(updates, "k", ["v", "t"])
    got = {r["k"]: (r["v"], r["t"]) for r in table.read().collect()}
    assert len(got) == 60 and got[5] == (500.0, "new") and got[9] == (13.5, "new") and got[1] == (1.5, "old")
    changed = {p for p, f in table.current()["folders"].items() if folders.get(p) != f}
    assert changed == {"p/ 1"}
    assert table.update(updates.where("k = 999"), "k", ["t"]) == table.current()["version"]


def test_rejected_lines_are_kept_apart_and_counted(spark, scratch):
    good = ['{"number": %d, "title": "t%d", "user": {"login": "a"}}' % (i, i) for i in range(20)]
    bad = ['{"number": 1, "title": "cut', "[1]", "text", '{"number": "no number"}']
    Path(scratch, "prs.jsonl").write_text("\n".join(good[:10] + bad + ["", "  "] + good[10:]) + "\n")
    records, rejects = read_landed(spark, f"{scratch}/prs.jsonl", schemas.RAW_PR)
    assert records.count() == 20 and set(records.columns) == {f.name for f in schemas.RAW_PR}
    for _ in range(2):  # a rerun counts the same
        assert quarantine(spark, rejects, f"{scratch}/quarantine") == 4
    assert {r["line"] for r in VersionedTable(spark, f"{scratch}/quarantine").read().collect()} == set(bad)


def test_csv_tables_are_read_as_they_were_written(spark, scratch):
    from roilens.sources.sinks import write_csv
    one = spark.createDataFrame([("U1", 'a "b",\nc', "D", "R", "Pro", 1.5, None, "Active", "x")], "user_id string, "
                                "employee_name string, department string, role string, license_type string, hourly_rate double, "
                                "ai_adoption_date date, employment_status string, github_username string")
    one = one.select(*[f.name for f in schemas.TABLES["users_master"] if f.name in one.columns])
    write_csv(one, f"{scratch}/users")
    assert load(spark, f"{scratch}/users", "users_master", "csv").first()["employee_name"] == 'a "b",\nc'
