"""The stages of a run (OP-89), each from tables to tables under one root.

Tables are Parquet with a record of commits (sources.sinks), by date where they have one. A stage reads its inputs pruned to `days` and replaces exactly these days,
those too that have no rows any more; without `days` it replaces the whole table. Statistics and curves over days always read all.

What fails is data: every file, security and day that a stage was given has a row with a status in its summary, and whatever fails leaves the others as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.config import Params
from tickweave.operators import evaluation as E
from tickweave.operators import ingest as I
from tickweave.operators import quantiles as Q
from tickweave.operators import views as V
from tickweave.operators.base import base_status, base_summary, with_base, with_forward_returns, with_status
from tickweave.operators.factors import FACTORS, factor_columns, factor_summary, run_factor
from tickweave.sources.readers import list_raw, read_factor_stats, read_overrides, read_raw, read_table
from tickweave.sources.sinks import write_table

KEYS = ["date", "security_id"]
AT = ["date", "sample_time"]
META = ["date", "sample_time", "security_id", "market", "tick_idx"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Run:
    def __init__(self, spark: SparkSession, root: str, params: Params = Params(), days: list[str] | None = None, factor: str = "bap", windows: dict | None = None):
        self.spark, self.root, self.p, self.days, self.factor, self.windows = spark, root, params, days, factor, windows
        self.dates = [f"{d[:4]}-{d[4:6]}-{d[6:]}" for d in days] if days else None

    def read(self, name: str, all_days: bool = False) -> DataFrame:
        return read_table(self.spark, self.root, name, None if all_days else self.dates)

    def write(self, df: DataFrame, name: str, partition: list[str] | None = None, covers: list[str] | None = None) -> None:
        write_table(df, self.root, name, partition, self.dates if partition is None else covers)

    # ---- ingest

    def sample(self, raw_root: str) -> None:
        raw = read_raw(self.spark, raw_root, self.days)
        self.write(I.sample_ticks(raw, self.p.sessions, self.p.freq), "sampled")
        files = I.file_status(list_raw(self.spark, raw_root, self.days), I.raw_counts(raw))
        rows = files.withColumn("date", I.iso_day(F.col("day"))).drop("day")
        self.write(I.resample_summary(self.read("sampled"), rows, KEYS, self.p.gap_threshold), "sample_summary")

    def clean(self, overrides: str | None = None) -> None:
        sampled = self.read("sampled")
        days = I.with_listed(I.suspended_days(sampled, [*KEYS, "day"], F.col("market"), F.col("status")), self.read("sample_summary"), KEYS)
        if overrides:
            days = I.expand_overrides(days, read_overrides(self.spark, overrides))
        else:
            days = days.withColumn("overridden", F.lit(False))
        decided = I.drop_decision(days)
        self.write(I.keep_days(sampled, decided, KEYS), "cleaned")
        self.write(I.dropped_report(decided, KEYS), "dropped")
        self.write(I.gap_review(decided, self.read("sample_summary"), KEYS, self.p.gap_threshold), "gap_review")

    def base(self) -> None:
        cleaned = self.read("cleaned")
        statuses = base_status(cleaned, KEYS)
        good = statuses.filter("Status = 'OK'").select(*KEYS, "market")
        base = with_base(cleaned.drop("market").join(good, KEYS)).drop("lacks").withColumnRenamed("volume", "CumVolume")
        self.write(base, "base")
        self.write(with_status(base_summary(self.read("base"), KEYS), statuses, KEYS), "base_summary")

    # ---- factors

    def factors(self) -> None:
        base = with_forward_returns(self.read("base"), self.p.horizons, KEYS, self.p.order)
        out = run_factor(base, self.factor, tuple(KEYS), self.p.order, self.windows)
        columns = [c for c in out.columns if c not in base.columns]
        self.write(out.select(*META, *[f"ret_fwd_{h}" for h in self.p.horizons], *columns), f"factor_{self.factor}")
        expected = self.read("base_summary").filter("Status = 'OK'")
        self.write(factor_summary(self.read(f"factor_{self.factor}"), self.factor, expected=expected), f"factor_{self.factor}_summary")

    def _pairs(self, df: DataFrame) -> list[tuple[str, str]]:
        return [(f, f"ret_fwd_{h}") for f in factor_columns(df, self.factor) for h in self.p.horizons]

    def cs_ic(self) -> None:
        df = self.read(f"factor_{self.factor}")
        self.write(E.cs_ic(df, self._pairs(df), AT, "security_id"), f"cs_ic_{self.factor}")
        ic = E.with_session(self.read(f"cs_ic_{self.factor}"), "sample_time", self.p.am_end, self.p.pm_start)
        self.write(E.cs_daily(ic, "date", ["ret", "session", "factor_col"]), f"cs_daily_{self.factor}")

    def ts_ic(self) -> None:
        df = self.read(f"factor_{self.factor}")
        self.write(E.ts_ic(df, self._pairs(df), KEYS, "sample_time", (self.p.am_end, self.p.pm_start)), f"ts_ic_{self.factor}")

    def ic_stats(self) -> None:
        keys = ["ret", "session", "factor_col"]
        number = E.window_number(F.col("factor_col"), self.factor)
        tag = lambda df: df.withColumns({"factor_window": number, "factor_name": F.lit(self.factor)})
        self.write(tag(E.cs_stats(self.read(f"cs_daily_{self.factor}", True), keys)), "cs_ic_stats", ["factor_name"], [self.factor])
        self.write(tag(E.ts_stats(self.read(f"ts_ic_{self.factor}", True), "date", "security_id", keys)), "ts_ic_stats", ["factor_name"], [self.factor])

    def ic_plot(self) -> DataFrame:
        """OP-91: what the plots show."""
        stats = self.read("cs_ic_stats").filter(F.col("factor_name") == self.factor)
        return V.plot_lines(stats)

    def ic_plots(self) -> DataFrame:
        """OP-91 for both kinds of coefficients, told apart by ic_type."""
        kinds = [self.read(f"{k}_ic_stats").filter(F.col("factor_name") == self.factor) for k in ("cs", "ts")]
        return union_all([V.plot_lines(df).withColumn("ic_type", F.lit(k)) for df, k in zip(kinds, ("CS", "TS"))])

    # ---- quantiles and composites

    def _curves(self, buckets: DataFrame, name: str, q: int, count: str | None = None) -> None:
        daily = Q.daily_means(buckets, "date", q)
        self.write(daily, f"{name}_daily", [])
        self.write(Q.overall_means(daily, q), f"{name}_summary", [])
        self.write(Q.cumulative_ticks(buckets, "date", "sample_time", q), f"{name}_cum_tick")
        self.write(Q.cumulative_days(buckets, "date", q, count), f"{name}_cum_daily", [])

    def cs_quantile(self) -> None:
        """One table for all horizons, told apart by ret: they share the buckets, and every curve is grouped by ret."""
        df = self.read(f"factor_{self.factor}")
        name, factors = f"quantile_{self.factor}", factor_columns(df, self.factor)
        self.write(Q.bucket_returns(df, factors, [f"ret_fwd_{h}" for h in self.p.horizons], AT, "security_id", self.p.quantiles), name)
        self._curves(self.read(name, True), name, self.p.quantiles)

    def cs_quantile_chart(self, q: int | None = None, ret: str | None = None) -> DataFrame:
        """OP-72, OP-92: what the charts of one horizon show, the first by default."""
        ret = ret or f"ret_fwd_{self.p.horizons[0]}"
        return self._chart(f"quantile_{self.factor}", q or self.p.quantiles, ret).drop("ret")

    def cs_quantile_charts(self, q: int | None = None) -> DataFrame:
        """The charts of all horizons, told apart by ret."""
        return self._chart(f"quantile_{self.factor}", q or self.p.quantiles)

    def _chart(self, name: str, q: int, ret: str | None = None) -> DataFrame:
        of_ret = lambda df: df.filter(F.col("ret") == ret) if ret else df
        ticks, days = of_ret(self.read(f"{name}_cum_tick", True)), of_ret(self.read(f"{name}_cum_daily", True))
        return Q.chart_curve(Q.stitched_ticks(ticks, days, "date", "sample_time", q), "date", "sample_time")

    def multi_factor_quantile(self, threshold: float | None = None) -> None:
        threshold = self.p.ic_threshold if threshold is None else threshold
        stats = read_factor_stats(self.spark, self.root)
        weights = Q.ic_weights(stats, threshold)
        self.write(weights, "weights", [])
        for h in self.p.horizons:
            ret = f"ret_fwd_{h}"
            chosen = Q.collected_weights(weights.filter(F.col("ret") == ret))
            owners = sorted({n for n in FACTORS for c in chosen if c.startswith(f"{n}_") and not (n == "mom" and c.startswith("acc_"))})
            if not chosen:  # no factor reaches the threshold: a composite without values, so that none of an earlier run stays
                owners = [r["factor_name"] for r in stats.select("factor_name").distinct().orderBy("factor_name").limit(1).collect()]
            tables = [self.read(f"factor_{n}") for n in owners]
            panel = Q.with_returns([t.select(*AT, "security_id", ret, *[c for c in chosen if c in t.columns]) for t in tables], [*AT, "security_id"], [ret])
            scored = Q.composite(panel, chosen, AT, "security_id") if chosen else panel.withColumn("composite", F.lit(None).cast("double"))
            deciles = Q.composite_deciles(scored, ret, AT, "security_id", self.p.deciles)
            name = f"composite_{ret}"
            self.write(deciles.withColumn("factor_col", F.lit("composite")), name)
            self._curves(self.read(name, True), name, self.p.deciles, "g1")
            self.write(self._chart(name, self.p.deciles), f"{name}_chart", [])
