"""Statistics that days are added to (OP-61, OP-62, OP-70): states by key instead of old panels.

A state holds for each key and value the count, the mean and the sum of squares about it, and how many days and rows it has seen. Two states of different days are merged
pairwise, without loss where means are far apart; so a new day needs its own panel and the state, however long the history is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.exprs import div

TINY = 1e-12


def state_of(df: DataFrame, keys: list[str], values: list[str], date: str) -> DataFrame:
    """(keys, n_days, n_rows, n_v, mean_v, m2_v) of the days in df."""
    squares = lambda v: F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0))
    days = F.size(F.collect_set(date))  # of the days added at once
    return df.groupBy(*keys).agg(
        days.cast("long").alias("n_days"), F.count("*").alias("n_rows"),
        *[c.alias(f"{k}_{v}") for v in values for k, c in (("n", F.count(v)), ("mean", F.coalesce(F.avg(v), F.lit(0.0))), ("m2", squares(v)))],
    )


def merged(one: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The state of both; their days are different ones. A key may be missing in either."""
    left, right = one.select(F.struct(*one.columns).alias("a")), other.select(F.struct(*other.columns).alias("b"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = left.join(right, same, "full")
    of = lambda side, c, none: F.coalesce(F.col(f"{side}.{c}"), F.lit(none))
    out = {c: of("a", c, 0) + of("b", c, 0) for c in ("n_days", "n_rows")}
    for v in values:
        na, nb = of("a", f"n_{v}", 0), of("b", f"n_{v}", 0)
        apart = of("b", f"mean_{v}", 0.0) - of("a", f"mean_{v}", 0.0)
        share = F.coalesce(div(nb, na + nb), F.lit(0.0))
        out[f"n_{v}"] = na + nb
        out[f"mean_{v}"] = F.when(na == 0, of("b", f"mean_{v}", 0.0)).otherwise(of("a", f"mean_{v}", 0.0) + apart * share)
        out[f"m2_{v}"] = of("a", f"m2_{v}", 0.0) + of("b", f"m2_{v}", 0.0) + apart * apart * na * share
    key = [F.when(F.col("a").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return both.select(*key, *[c.alias(k) for k, c in out.items()])


def _mean(v: str) -> Column:
    return F.when(F.col(f"n_{v}") > 0, F.col(f"mean_{v}"))


def _ratio(mean: Column, spread: Column) -> Column:
    return F.when(spread > TINY, div(mean, spread))


def cs_stats(state: DataFrame, keys: list[str]) -> DataFrame:
    """OP-61 of a state of daily ic and rankic."""
    spread = lambda v: F.when(F.col(f"n_{v}") > 1, F.sqrt(F.col(f"m2_{v}") / (F.col(f"n_{v}") - 1)))
    return state.select(
        *keys, _mean("ic").alias("ic_mean"), _mean("rankic").alias("rankic_mean"), spread("ic").alias("ic_std"), spread("rankic").alias("rankic_std"), F.col("n_rows").alias("n_days"),
        _ratio(_mean("ic"), spread("ic")).alias("icir"), _ratio(_mean("rankic"), spread("rankic")).alias("rankic_ir"),
    )


def ts_stats(state: DataFrame, days: DataFrame, keys: list[str], security: str) -> DataFrame:
    """OP-62 of a state by security (keys, security) of ts_ic and ts_rankic, and one by keys alone, for the days."""
    spread = lambda v: F.when(F.col(f"n_{v}") >= 2, F.sqrt(F.col(f"m2_{v}") / F.col(f"n_{v}")))
    own = {"m": _mean("ts_ic"), "rm": _mean("ts_rankic"), "ir": _ratio(_mean("ts_ic"), spread("ts_ic")), "rir": _ratio(_mean("ts_rankic"), spread("ts_rankic"))}
    each = state.select(*keys, security, *[c.alias(k) for k, c in own.items()]).groupBy(*keys).agg(
        F.avg("m").alias("ic_mean"), F.avg("rm").alias("rankic_mean"), F.avg("ir").alias("icir"), F.avg("rir").alias("rankic_ir"), F.count("*").alias("n_stocks")
    )
    return each.join(days.select(*keys, "n_days"), keys).select(*keys, "ic_mean", "rankic_mean", "icir", "rankic_ir", "n_days", "n_stocks")


def totals_of(buckets: DataFrame, keys: list[str], groups: list[str], count: str, date: str) -> DataFrame:
    """(keys, date, groups, n_ticks, n_rows): each day's sums, the values of `count` and the ticks."""
    return buckets.groupBy(*keys, date).agg(*[F.sum(g).alias(g) for g in groups], F.count(count).alias("n_ticks"), F.count("*").alias("n_rows"))


def continued(day: DataFrame, before: DataFrame, keys: list[str], groups: list[str], date: str) -> DataFrame:
    """OP-70 for one day more: its totals on top of the last row of each curve (before: keys, date, groups, long_short, n_ticks; its last value that is there counts)."""
    last = before.groupBy(*keys).agg(*[F.max_by(F.when(F.col(g).isNotNull(), F.col(g)), F.when(F.col(g).isNotNull(), F.col(date))).alias(f"_{g}") for g in groups], F.max("n_ticks").alias("_n"))
    joined = day.join(last, keys, "left")
    on_top = joined.select(*keys, date, *[(F.col(g) + F.coalesce(f"_{g}", F.lit(0.0))).alias(g) for g in groups], (F.col("n_ticks") + F.coalesce("_n", F.lit(0))).alias("n_ticks"))
    return on_top.select(*keys, date, *groups, (F.col(groups[-1]) - F.col(groups[0])).alias("long_short"), "n_ticks")
