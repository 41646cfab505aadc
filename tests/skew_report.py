"""Hot-key check: per-stage task balance of the campaign-feature plan when one
keyword holds a third of all rows and one campaign another third.

    python tests/skew_report.py [sf_dir] [scratch_dir]

The skewed input is derived by Spark from the given tables (keyword of every
third line item replaced by one hot keyword, client of another third by one
hot client) and split into 64 partitions to mimic many scan tasks.  The event
log (written to the scratch folder) gives shuffle-read records per task.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(folder: str):
    import zstandard
    for f in sorted(glob.glob(folder + "/eventlog_v2_*/events_*")):
        if f.endswith(".zstd"):
            with open(f, "rb") as fh:
                text = zstandard.ZstdDecompressor().stream_reader(fh).read().decode()
        else:
            text = open(f).read()
        for line in text.splitlines():
            yield json.loads(line)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    scratch = argv[2] if len(argv) > 2 else tempfile.mkdtemp(prefix="skew-", dir="/tmp")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", scratch)
             .config("spark.sql.shuffle.partitions", "32")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             # local-size skew thresholds, so AQE's split is visible at sf0.1
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256k")
             .config("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from adlens.operators import clustering as C
    from adlens.operators import features as FT
    from adlens.sources import tables as TB

    li = TB.table(spark, sf_dir, "lineitem")
    rows = (TB.keyword_rows(spark, sf_dir).repartition(64)
            .withColumn("keyword", F.when(F.rand(7) < 1 / 3, F.lit("Hot Key")).otherwise(F.col("keyword")))
            .withColumn("client_id", F.when(F.rand(8) < 1 / 3, F.lit("0hot")).otherwise(F.col("client_id"))))
    n_rows = li.count()
    spark.sparkContext.setJobGroup("skew", "campaign features on skewed rows")
    hist = FT.campaign_cluster_features(rows, C.fixed_centres_2d(36, scale=10.0, offset=0.5), 36)
    hist.write.format("noop").mode("overwrite").save()
    # per-row labels with a dictionary too large to broadcast (bound forced to 0):
    # sort-merge join, the hot keyword's partition split by AQE
    spark.sparkContext.setJobGroup("skew-join", "per-row labels, no broadcast")
    from adlens.operators import keywords as K
    c = C.fixed_centres_2d(36, scale=10.0, offset=0.5)
    dictionary = FT.label_dictionary(K.keyword_stats(rows), c)
    labelled = FT.label_keywords(rows, dictionary, c.default_cluster(), "normalized",
                                 max_broadcast_bytes=0)
    labelled.write.format("noop").mode("overwrite").save()
    spark.stop()

    for group in ("skew", "skew-join"):
        report(scratch, group, n_rows)


def report(scratch: str, group: str, n_rows: int) -> None:
    stage_job, jobs_in_group, tasks = {}, set(), {}
    names = {}
    for e in read_events(scratch):
        ev = e["Event"]
        if ev == "SparkListenerJobStart" and e.get("Properties", {}).get("spark.jobGroup.id") == group:
            jobs_in_group.add(e["Job ID"])
            for s in e["Stage IDs"]:
                stage_job[s] = e["Job ID"]
        elif ev == "SparkListenerStageCompleted":
            names[e["Stage Info"]["Stage ID"]] = e["Stage Info"]["Stage Name"][:40]
        elif ev == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            sr = m.get("Shuffle Read Metrics", {})
            recs = sr.get("Total Records Read", 0)
            inp = m.get("Input Metrics", {}).get("Records Read", 0)
            tasks.setdefault(e["Stage ID"], []).append((recs, inp, e["Task Info"]["Finish Time"] - e["Task Info"]["Launch Time"]))
    print(f"[{group}] input rows: {n_rows}; hot keyword ~1/3 of rows, hot client ~1/3 of rows")
    print(f"{'stage':>5} {'tasks':>5} {'shuffle-read records: max / median / total':>44} {'max task ms':>11}")
    for s in sorted(t for t in tasks if stage_job.get(t) in jobs_in_group):
        recs = [t[0] for t in tasks[s]]
        if sum(recs) == 0:
            continue
        print(f"{s:>5} {len(recs):>5} {max(recs):>14} / {int(statistics.median(recs)):>8} / {sum(recs):>10}"
              f"{max(t[2] for t in tasks[s]):>12}")


if __name__ == "__main__":
    main(sys.argv)
