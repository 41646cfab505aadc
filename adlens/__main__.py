"""Command line: run a workflow as a Spark job.

    python -m adlens stats    --keywords 'hdfs:///kw/*' --out stats/
    python -m adlens sweep    --keywords ... --dims 2 --ks 1,6,11 --out sweep/
    python -m adlens fit      --keywords ... --dims 2 --k 36 --model kmeans36/
    python -m adlens features --keywords ... --history ... --model kmeans36/ --k 36 \\
                              --exclude acct-x --out training/
    python -m adlens regress  --training training/ --k 36 --grid 36 --out regression/
    python -m adlens throughput --requests requests/ --width 3600 --out throughput/

The session comes from the environment (``spark-submit`` settings, or a
local master when run directly); outputs are parquet tables.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _ks(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


def _features(dims: int):
    from .operators import clustering as C
    return C.ONE_D if dims == 1 else C.TWO_D


def main(argv: list[str] | None = None) -> int:
    """Parse the command line and run one workflow; returns the exit code."""
    p = argparse.ArgumentParser(prog="adlens")
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("stats", help="keyword counts and mean quota impression")
    s.add_argument("--keywords", required=True)
    s.add_argument("--out", required=True)

    s = sub.add_parser("sweep", help="K-means over a list of K -> dispersion per K")
    s.add_argument("--keywords", required=True)
    s.add_argument("--dims", type=int, choices=(1, 2), default=2)
    s.add_argument("--ks", type=_ks, default=None)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--parallelism", type=int, default=2)
    s.add_argument("--out", required=True)

    s = sub.add_parser("fit", help="K-means at one K (best of restarts) -> saved model")
    s.add_argument("--keywords", required=True)
    s.add_argument("--dims", type=int, choices=(1, 2), default=2)
    s.add_argument("--k", type=int, required=True)
    s.add_argument("--restarts", type=int, default=1)
    s.add_argument("--model", required=True)

    s = sub.add_parser("features", help="campaign features joined with the history")
    s.add_argument("--keywords", required=True)
    s.add_argument("--history", required=True)
    s.add_argument("--kind", choices=("histogram", "avg"), default="histogram",
                   help="cluster histogram (needs --model, --k) or average of keyword averages")
    s.add_argument("--model")
    s.add_argument("--k", type=int)
    s.add_argument("--dims", type=int, choices=(1, 2), default=2)
    s.add_argument("--lookup-case", choices=("reference", "normalized"), default="reference")
    s.add_argument("--exclude", action="append", default=[])
    s.add_argument("--out", required=True)

    s = sub.add_parser("regress", help="gradient descent + forest grid + final forests")
    s.add_argument("--training", required=True)
    s.add_argument("--k", type=int, help="histogram width (not needed for avg features)")
    s.add_argument("--grid", choices=("21", "36"), default="36")
    s.add_argument("--trees", type=_ks, default=None, help="override the grid's tree counts")
    s.add_argument("--depths", type=_ks, default=None, help="override the grid's depths")
    s.add_argument("--no-final", action="store_true")
    s.add_argument("--parallelism", type=int, default=2)
    s.add_argument("--out", required=True)

    s = sub.add_parser("throughput", help="successful requests per window")
    s.add_argument("--requests", required=True)
    s.add_argument("--width", type=int, default=3600)
    s.add_argument("--out", required=True)

    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"adlens-{a.cmd}").getOrCreate()

    from .operators import clustering as C
    from .operators import features as FT
    from .operators import keywords as K
    from .operators import requests as RQ
    from .plans import flows
    from .sources.text import read_history_rows, read_keyword_rows

    if a.cmd == "stats":
        K.keyword_stats(read_keyword_rows(spark, a.keywords)).write.mode("overwrite").parquet(a.out)
    elif a.cmd == "sweep":
        rows = read_keyword_rows(spark, a.keywords)
        metrics, _ = flows.keyword_clustering(rows, a.ks or C.K_SWEEP, _features(a.dims),
                                              seed=a.seed, parallelism=a.parallelism)
        metrics.write.mode("overwrite").parquet(a.out)
    elif a.cmd == "fit":
        rows = read_keyword_rows(spark, a.keywords)
        _, best = flows.keyword_restarts(rows, a.k, max(1, a.restarts), _features(a.dims))
        C.save_model(best, a.model, spark)
    elif a.cmd == "features":
        kw, hist = read_keyword_rows(spark, a.keywords), read_history_rows(spark, a.history)
        if a.kind == "avg":
            rows = flows.campaign_avg_training_rows(kw, hist, a.lookup_case,
                                                    excluded_accounts=a.exclude)
        else:
            if not a.model or not a.k:
                p.error("features --kind histogram needs --model and --k")
            rows = flows.campaign_training_rows(kw, hist, C.load_model(spark, a.model),
                                                _features(a.dims), a.k, a.lookup_case,
                                                excluded_accounts=a.exclude)
        rows.write.mode("overwrite").parquet(a.out)
    elif a.cmd == "regress":
        train = spark.read.parquet(a.training)
        grid = flows.FOREST_GRID_21 if a.grid == "21" else flows.FOREST_GRID_36
        grid = (a.trees or grid[0], a.depths or grid[1])
        if "avg_of_avg" in train.columns:
            extra = ["avg_of_avg"]
        elif a.k:
            extra = FT.histogram_columns(a.k)
        else:
            p.error("regress needs --k for histogram features")
        res = flows.campaign_regression(
            train, FT.feature_columns(extra), grid,
            None if a.no_final else flows.FINAL_FORESTS, parallelism=a.parallelism)
        res.linear.weights_frame(spark).write.mode("overwrite").parquet(a.out + "/linear_weights")
        res.grid.write.mode("overwrite").parquet(a.out + "/grid")
        if res.final is not None:
            res.final.write.mode("overwrite").parquet(a.out + "/final")
            res.residuals.write.mode("overwrite").parquet(a.out + "/residuals")
    elif a.cmd == "throughput":
        from .sources.tables import request_log_of
        log = spark.read.parquet(a.requests)
        if "visitor_id" not in log.columns:
            log = request_log_of(log)
        RQ.throughput(log, a.width).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
