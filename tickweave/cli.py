"""Command line (OP-89): python -m tickweave.cli STAGE --root DIR [...]. Parallelism is Spark's."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tickweave.operators.factors import FACTORS
from tickweave.plans.stages import Run

STAGES = ["sample", "clean", "base", "factors", "cs_ic", "ts_ic", "ic_stats", "ic_plot", "cs_quantile", "cs_quantile_chart", "multi_factor_quantile"]

#: Stages whose method of that name gives one part; the command line writes all parts.
WHOLE = {"ic_plot": "ic_plots", "cs_quantile_chart": "cs_quantile_charts"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickweave", description="Tick factors from raw snapshots to evaluated portfolios.")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--root", required=True, help="where the tables are")
    p.add_argument("--raw", default="data", help="raw files, in folders by day (sample)")
    p.add_argument("--date", help="one day, yyyymmdd; all by default")
    p.add_argument("--factor", default="bap", choices=sorted(FACTORS))
    p.add_argument("--overrides", help="list of days to drop (clean)")
    p.add_argument("--threshold", type=float, default=0.02, help="least mean coefficient (multi_factor_quantile)")
    p.add_argument("--workers", type=int, help="cores of a local session; a cluster has its own")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"tickweave {a.stage}").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(f"local[{a.workers}]") if a.workers else builder).getOrCreate()
    run = Run(spark, a.root, days=[a.date] if a.date else None, factor=a.factor)
    stage = getattr(run, WHOLE.get(a.stage, a.stage))
    arguments = {"sample": (a.raw,), "clean": (a.overrides,), "multi_factor_quantile": (a.threshold,)}.get(a.stage, ())
    out = stage(*arguments)
    if out is not None:
        run.write(out, f"{a.stage}_{a.factor}", [])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
