"""Summarise the final (AQE) physical plan of registered queries.

    python tests/plan_report.py [sf_dir] [name ...]

Per query: the jobs and stages that run while the frame is built (written
tables, measured dictionaries, fits), then of the final plan its shuffles
(Exchange), broadcasts, join strategies, reused exchanges, scans with their
read schema and pushed filters, and whether any Python evaluation
(BatchEvalPython / ArrowEvalPython) appears.  The eager jobs' own shuffles
are the stages between their scans and results, counted here, not drawn.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_plan(df) -> str:
    """Run the frame's own query execution, then print its final AQE plan."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def summarise(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    lines = final.split("\n")
    out = {
        "exchanges": sum(1 for x in lines if re.search(r"\bExchange (hash|range|round|Single|SinglePartition)", x)),
        "broadcasts": sum(1 for x in lines if "BroadcastExchange" in x),
        "joins": [f"{m.group(1)}:{m.group(2)}" for m in
                  (re.search(r"(\w+Join) \[.*?\], \[.*?\], (\w+)", x) for x in lines) if m],
        "reused": sum(1 for x in lines if "ReusedExchange" in x),
        "python": any(("EvalPython" in x) or ("PythonUDF" in x) for x in lines),
        "scans": [],
    }
    for x in lines:
        m = re.search(r"FileScan (\w+) \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\].*?ReadSchema: (\S+)", x)
        if m:
            out["scans"].append((m.group(1), len(m.group(2).split(",")), m.group(3)[:80]))
        elif "Scan ExistingRDD" in x or "Scan parquet" in x:
            out["scans"].append(("rdd/parquet", x.strip()[:60], ""))
    return out


class _NoJob:
    stageIds = ()


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    names = argv[2:]
    from adlens.session import local_session
    import __spark_entry__ as E
    spark = local_session(8, 16)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    for name, fn in E.queries().items():
        if names and name not in names:
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        df = fn(spark, sf_dir)
        tracker = spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
        stages = {i for j in jobs for i in (tracker.getJobInfo(j) or _NoJob).stageIds}
        spark.sparkContext.setJobGroup(f"run-{name}", name)
        s = summarise(final_plan(df))
        print(f"{name}: eager_jobs={len(jobs)} eager_stages={len(stages)} exchanges={s['exchanges']} broadcasts={s['broadcasts']} reused={s['reused']} "
              f"python={s['python']} joins={s['joins']}")
        for sc in s["scans"]:
            print("    scan", sc)


if __name__ == "__main__":
    main(sys.argv)
