"""Write the formatted physical plans of the headline queries to PLANS.md.

    python tools/explain.py [sf_dir]
"""

from __future__ import annotations

import io
import sys
from contextlib import redirect_stdout
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roilens.session import local_session  # noqa: E402
from roilens.plans.catalog import QUERIES  # noqa: E402

NAMES = ("user_roi_sql", "user_summary", "scan_logs", "pr_delta_sql", "monthly_dept_trend", "top_contributors_sql",
         "ingest_pull_requests", "spend_vs_productivity")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    out = ["# Physical plans of the headline queries", "",
           f"`python tools/explain.py {sf}` -- `explain('formatted')`, tree part, before adaptive re-planning.", ""]
    for name in NAMES:
        buf = io.StringIO()
        with redirect_stdout(buf):
            QUERIES[name](spark, sf).explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n(1)")[0]
        scans = []
        for block in (b.strip() for b in text.split("\n\n")):
            if block and " Scan parquet" in block.splitlines()[0]:
                keep = [ln for ln in block.splitlines()
                        if ln.startswith(("(", "Location", "PushedFilters", "ReadSchema"))]
                scans.append("\n".join(k.replace("file:/root/testdata/", "") for k in keep))
        out += [f"## {name}", "", "```", tree.strip(), "```", "", "Scans:", "", "```", "\n\n".join(scans), "```", ""]
    Path(__file__).resolve().parents[1].joinpath("PLANS.md").write_text("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
