"""Command line for the three jobs (``spark-submit rfmlens/plans/cli.py <job> ...``).

The session comes from ``spark-submit`` (cluster settings are not touched);
every path and parameter the reference hard-wires is an argument.

    score    userbase + monthly usage + device snapshots + app CSVs -> scores
    cluster  wide per-device table -> silhouette sweep + k-means labels
    profile  clustered table -> profiles + audience lists
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from rfmlens import config as C  # noqa: E402
from rfmlens.plans import clustering, profiling, scoring  # noqa: E402
from rfmlens.session import clear_stages  # noqa: E402
from rfmlens.sources.sinks import write_csv, write_parquet  # noqa: E402


def _csv_list(text: str) -> tuple[str, ...]:
    return tuple(x for x in (t.strip() for t in text.split(",")) if x)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rfmlens")
    sub = p.add_subparsers(dest="job", required=True)

    s = sub.add_parser("score", help="RFM measures, distributions and 0-5 scores")
    for name in ("userbase", "usage", "devices", "app-master", "app-level", "app-lifestage", "out"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--months", type=_csv_list, default=None, help="yyyyMM list; all months when absent")
    s.add_argument("--anchor-day", type=dt.date.fromisoformat, default=C.REFERENCE_ANCHOR_DAY)
    s.add_argument("--category", default=C.REFERENCE_CATEGORY)
    s.add_argument("--category-col", default="app_l1_name")
    s.add_argument("--daily-excluded", type=_csv_list, default=C.REFERENCE_DAILY_EXCLUDED)
    s.add_argument("--spend-excluded", type=_csv_list, default=C.REFERENCE_SPEND_EXCLUDED)
    s.add_argument("--fx-rate", type=float, default=C.REFERENCE_FX_RATE)
    s.add_argument("--scale", type=float, default=C.REFERENCE_SCALE)
    s.add_argument("--mode", default="overwrite")

    c = sub.add_parser("cluster", help="features, silhouette sweep, k-means labels")
    c.add_argument("--wide", required=True, help="wide per-device table (Parquet, or CSV with --csv)")
    c.add_argument("--csv", action="store_true")
    c.add_argument("--out", required=True)
    c.add_argument("--features", type=_csv_list, default=C.REFERENCE_FEATURES)
    c.add_argument("--ks", type=lambda t: tuple(int(x) for x in _csv_list(t)), default=C.REFERENCE_SWEEP_KS)
    c.add_argument("--k", type=int, default=C.REFERENCE_K)
    c.add_argument("--sweep", action="store_true", help="choose k from the sweep (best with k >= --min-k)")
    c.add_argument("--min-k", type=int, default=4)
    c.add_argument("--seed", type=int, default=C.DEFAULT_SEED)
    c.add_argument("--n-init", type=int, default=1)
    c.add_argument("--mode", default="overwrite")

    r = sub.add_parser("profile", help="cluster profiles and audience lists")
    r.add_argument("--clustered", required=True, help="clustered table (Parquet, or CSV with --csv)")
    r.add_argument("--csv", action="store_true")
    r.add_argument("--out", required=True)
    r.add_argument("--means-of", type=_csv_list, required=True)
    r.add_argument("--share-group", action="append", default=[],
                   help="total=col1,col2,... (repeatable): columns shown as shares of the total")
    r.add_argument("--mode", default="overwrite")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"rfmlens-{args.job}").getOrCreate()
    try:
        _run(args, spark)
    finally:
        clear_stages(spark)   # the results are written: nothing reads them any more


def _run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.job == "score":
        cfg = C.ScoringConfig(anchor_day=args.anchor_day, daily_excluded=args.daily_excluded,
                              spend_excluded=args.spend_excluded, category_col=args.category_col,
                              category=args.category, fx_rate=args.fx_rate, scale=args.scale)
        inp = scoring.load_inputs(spark, args.userbase, args.usage, args.devices, args.app_master,
                                  args.app_level, args.app_lifestage, args.months)
        scoring.run(inp, cfg, args.out, args.mode)
    elif args.job == "cluster":
        wide = (spark.read.option("header", "true").csv(args.wide) if args.csv
                else spark.read.parquet(args.wide))
        cfg = C.ClusteringConfig(features=args.features, ks=args.ks, k=args.k, seed=args.seed,
                                 n_init=args.n_init)
        model, sweep = clustering.cluster_table(wide, cfg, sweep=args.sweep, min_k=args.min_k)
        write_parquet(model, f"{args.out}/clustered", mode=args.mode)
        if sweep is not None:
            write_csv(sweep, f"{args.out}/silhouette", mode=args.mode, single_file=True)
    else:
        model = (profiling.load_clustered(spark, args.clustered) if args.csv
                 else spark.read.parquet(args.clustered))
        groups = {}
        for g in args.share_group:
            total, _, members = g.partition("=")
            groups[total] = _csv_list(members)
        profiling.run(model, args.out, args.means_of, groups, mode=args.mode)


if __name__ == "__main__":
    main()
