"""What the user interface asks for (OP-79 to OP-88, OP-91)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.exprs import div


def available(df: DataFrame, column: str) -> DataFrame:
    """OP-79."""
    return df.select(column).distinct().orderBy(column)


def natural_order(name: Column) -> Column:
    """OP-80: the first whole number in a name; names without one come first."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits == "", -1).otherwise(digits.try_cast("int"))


def ic_summary(stats: DataFrame, ret: str, session: str, factor: str | None = None) -> DataFrame:
    """OP-81."""
    rows = stats.filter((F.col("ret") == ret) & (F.col("session") == session))
    rows = rows.filter(F.col("factor_name") == factor) if factor else rows
    return rows.orderBy(*[c for c in ("factor_name",) if c in rows.columns], "factor_window", "factor_col")


def trend(ic: DataFrame, factor_col: str, order: str, **equal) -> DataFrame:
    """OP-82, OP-83: one factor's rows (of one day, horizon or session if given) in order."""
    rows = ic.filter(F.col("factor_col") == factor_col)
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows.orderBy(order)


def _last_day(cum_days: DataFrame, date: str) -> DataFrame:
    columns = [c for c in cum_days.columns if c not in ("factor_col", date)]
    last = F.max_by(F.struct(*columns), date)
    return cum_days.groupBy("factor_col").agg(F.max(date).alias(date), last.alias("last")).select("factor_col", date, "last.*")


def monotonicity(cum_days: DataFrame, date: str) -> DataFrame:
    """OP-84: (g1 - g5) / (g2 - g4) on the last day."""
    under = F.col("g2") - F.col("g4")
    score = F.when(F.abs(under) >= 1e-12, div(F.col("g1") - F.col("g5"), under))
    return _last_day(cum_days, date).select("factor_col", score.alias("monotonicity"))


def pnl_stats(cum_days: DataFrame, date: str, q: int = 5) -> DataFrame:
    """OP-85: totals, ticks of all days (n_ticks runs over days, as the totals do), and totals for each tick."""
    names = [*[f"g{k}" for k in range(1, q + 1)], "long_short"]
    last = _last_day(cum_days, date).withColumnRenamed("n_ticks", "total_ticks")
    return last.select("factor_col", *names, "total_ticks", *[div(F.col(c), F.col("total_ticks")).alias(f"{c}_per_tick") for c in names])


def day_pnl(cum_ticks: DataFrame, date: str, time: str, q: int = 5) -> DataFrame:
    """OP-86: for each day the last row with a value of the last bucket: its values, and over the number of such rows."""
    names = [*[f"g{k}" for k in range(1, q + 1)], "long_short"]
    there = cum_ticks.filter(F.col(f"g{q}").isNotNull())
    last = there.groupBy("factor_col", date).agg(F.max_by(F.struct(*names), time).alias("last"), F.count("*").alias("n"))
    return last.select("factor_col", date, "last.*", "n", *[div(F.col(f"last.{c}"), F.col("n")).alias(f"{c}_per_tick") for c in names])


def search(metadata: DataFrame, pattern: str) -> DataFrame:
    """OP-87: rows where any column matches the expression, in either case."""
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metadata.columns])
    return metadata.filter(F.exists(texts, lambda t: t.rlike(f"(?i){pattern}")))


def plot_lines(stats: DataFrame) -> DataFrame:
    """OP-91: (ret, factor_window, line, mean, ir): six lines for each horizon, the sessions' coefficients and rank coefficients."""
    lines = F.array(
        F.struct(F.concat(F.lit("IC "), "session").alias("line"), F.col("ic_mean").alias("mean"), F.col("icir").alias("ir")),
        F.struct(F.concat(F.lit("RankIC "), "session").alias("line"), F.col("rankic_mean").alias("mean"), F.col("rankic_ir").alias("ir")),
    )
    return stats.select("ret", "factor_col", "factor_window", F.inline(lines)).orderBy("ret", "line", "factor_window")
