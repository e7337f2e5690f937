"""Quantile portfolios and their curves (OP-65 to OP-72), and weighted composites of several factors (OP-73 to OP-78)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.exprs import add_up, div


def groups(q: int) -> list[str]:
    return [f"g{k}" for k in range(1, q + 1)]


def keys_of(df: DataFrame) -> list[str]:
    """What tells curves apart: the factor, and the return where a table holds several."""
    return [c for c in ("ret", "factor_col") if c in df.columns]


def bucket_of(factor: str, at: list[str], security: str, q: int) -> Column:
    """OP-65: 1 to q by ordinal rank among the cross-section's values, ties by security; NULL if there are fewer than q.

    Sizes differ from ntile's where q doesn't divide the count.
    """
    rows = W.partitionBy(*at).orderBy(F.col(factor).asc_nulls_last(), security)
    n = F.count(factor).over(W.partitionBy(*at))
    place = F.floor((F.row_number().over(rows) - 1) * q / n).cast("int") + 1
    return F.when(F.col(factor).isNotNull() & (n >= q), place)


def bucket_returns(panel: DataFrame, factors: list[str], ret: str | list[str], at: list[str], security: str, q: int = 5) -> DataFrame:
    """OP-66: (at, [ret,] factor_col, g1..gq, n_valid) - mean return of each bucket in each cross-section. Several returns share the buckets, and their rows are told apart by ret."""
    rets = [ret] if isinstance(ret, str) else ret
    marked = panel.select(*at, security, *rets, *factors).withColumns({f"_bucket_{f}": bucket_of(f, at, security, q) for f in factors})
    aggs, rows = [], []
    for k, f in enumerate(factors):
        aggs.append(F.count(f).alias(f"_{k}_n"))
        for j, r in enumerate(rets):
            aggs += [F.avg(F.when(F.col(f"_bucket_{f}") == g, F.col(r))).alias(f"_{k}_{j}_{g}") for g in range(1, q + 1)]
            told = [] if isinstance(ret, str) else [F.lit(r).alias("ret")]
            rows.append(F.struct(*told, F.lit(f).alias("factor_col"), *[F.col(f"_{k}_{j}_{g}").alias(f"g{g}") for g in range(1, q + 1)], F.col(f"_{k}_n").alias("n_valid")))
    return marked.groupBy(*at).agg(*aggs).select(*at, F.inline(F.array(*rows)))


def daily_means(buckets: DataFrame, date: str, q: int = 5) -> DataFrame:
    """OP-67."""
    return buckets.groupBy(*keys_of(buckets), date).agg(*[F.avg(g).alias(g) for g in groups(q)])


def overall_means(daily: DataFrame, q: int = 5) -> DataFrame:
    """OP-68."""
    return daily.groupBy(*keys_of(daily)).agg(*[F.avg(g).alias(g) for g in groups(q)])


def _running(columns: list[str], rows) -> dict[str, Column]:
    """Running sums that are missing where the value is, but go on after it."""
    return {c: F.when(F.col(c).isNotNull(), F.sum(c).over(rows)) for c in columns}


def cumulative_ticks(buckets: DataFrame, date: str, time: str, q: int = 5) -> DataFrame:
    """OP-69: sums within the day, and long_short of the last and first bucket."""
    keys = keys_of(buckets)
    rows = W.partitionBy(*keys, date).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = buckets.withColumns(_running(groups(q), rows))
    return cum.select(*keys, date, time, *groups(q), (F.col(f"g{q}") - F.col("g1")).alias("long_short"))


def cumulative_days(buckets: DataFrame, date: str, q: int = 5, count: str | None = None) -> DataFrame:
    """OP-70: each day's sum, summed over days, and so is n_ticks, the number of values of `count` (the last bucket). A day without values is missing and doesn't reset.

    A day's sum is the last value of its cumulative curve that is there, so no curve is built.
    """
    count, keys = count or f"g{q}", keys_of(buckets)
    days = buckets.groupBy(*keys, date).agg(*[F.sum(g).alias(g) for g in groups(q)], F.count(count).alias("n_ticks"))
    rows = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = days.withColumns({**_running(groups(q), rows), "n_ticks": F.sum("n_ticks").over(rows)})
    return cum.select(*keys, date, *groups(q), (F.col(f"g{q}") - F.col("g1")).alias("long_short"), "n_ticks")


def stitched_ticks(cum_ticks: DataFrame, cum_days: DataFrame, date: str, time: str, q: int = 5) -> DataFrame:
    """OP-71: the intraday curves, each on top of the days before it (the last value that is there)."""
    names, keys = groups(q), keys_of(cum_ticks)
    earlier = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    base = cum_days.select(*keys, date, *[F.coalesce(F.last(g, ignorenulls=True).over(earlier), F.lit(0.0)).alias(f"_{g}") for g in names])
    joined = cum_ticks.join(base, [*keys, date])
    out = joined.select(*keys, date, time, *[(F.col(g) + F.col(f"_{g}")).alias(g) for g in names])
    return out.withColumn("long_short", F.col(f"g{q}") - F.col("g1"))


def chart_curve(stitched: DataFrame, date: str, time: str) -> DataFrame:
    """OP-72, OP-92: the curve with its running tick number and a mark at each month's first day; date as yyyy-MM-dd.

    Ticks are numbered within their day, on top of the counts of the days before: a row a day carries these, and no window holds more ticks than a day has.
    """
    keys = keys_of(stitched)
    days = stitched.groupBy(*keys, F.col(date).alias("_day")).agg(F.count("*").alias("_ticks"))
    earlier = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    month = F.substring(F.col("_day").cast("string"), 1, 7)
    days = days.select(*[F.col(k).alias(f"_{k}") for k in keys], "_day", F.coalesce(F.sum("_ticks").over(earlier), F.lit(0)).alias("_before"), (F.col("_day") == F.min("_day").over(W.partitionBy(*keys, month))).alias("_first"))
    numbered = stitched.withColumn("_place", F.row_number().over(W.partitionBy(*keys, date).orderBy(time)) - 1)
    joined = numbered.join(days, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col(date) == F.col("_day")))
    return joined.select(*stitched.columns, (F.col("_before") + F.col("_place")).cast("int").alias("x"), (F.col("_first") & (F.col("_place") == 0)).alias("month_start"))


# ---- composites


def ic_weights(stats: DataFrame, threshold: float = 0.02, horizon: str = "ret", session: str = "all") -> DataFrame:
    """OP-73: (horizon, factor_col, ic_mean, weight) of the factors whose mean coefficient reaches the threshold."""
    chosen = stats.filter((F.col("session") == session) & (F.abs("ic_mean") >= threshold))
    total = F.sum(F.abs("ic_mean")).over(W.partitionBy(horizon))
    return chosen.select(horizon, "factor_col", "ic_mean", div(F.col("ic_mean"), total).alias("weight"))


def percentile_score(value: str, keys: list[str], security: str) -> Column:
    """OP-74: 0-based ordinal rank over the number of values, in [0, 1); not percent_rank."""
    rows = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), security)
    return F.when(F.col(value).isNotNull(), div(F.row_number().over(rows) - 1, F.count(value).over(W.partitionBy(*keys))))


def composite(panel: DataFrame, weights: dict[str, float], at: list[str], security: str) -> DataFrame:
    """OP-75: add composite, the weighted score over the factors that a row has, over the absolute weights of those.

    weights has a number for each factor chosen: as many as there are factors.
    """
    scored = panel.withColumns({f"_score_{f}": percentile_score(f, at, security) for f in weights})
    score = lambda f: F.col(f"_score_{f}")
    total = add_up(*[F.coalesce(F.lit(w) * score(f), F.lit(0.0)) for f, w in weights.items()])
    under = add_up(*[F.when(score(f).isNotNull(), F.lit(abs(w))).otherwise(0.0) for f, w in weights.items()])
    return scored.withColumn("composite", F.when(under > 1e-9, div(total, under))).drop(*[f"_score_{f}" for f in weights])


def collected_weights(weights: DataFrame) -> dict[str, float]:
    """A row for each factor."""
    return {r["factor_col"]: r["weight"] for r in weights.select("factor_col", "weight").orderBy("factor_col").collect()}


def composite_deciles(scored: DataFrame, ret: str, at: list[str], security: str, q: int = 10) -> DataFrame:
    """OP-76: (at, composite_mean, composite_std, n_valid, g1..gq)."""
    marked = scored.withColumn("_bucket", bucket_of("composite", at, security, q))
    return marked.groupBy(*at).agg(
        F.avg("composite").alias("composite_mean"), F.stddev_pop("composite").alias("composite_std"), F.count("composite").alias("n_valid"),
        *[F.avg(F.when(F.col("_bucket") == g, F.col(ret))).alias(f"g{g}") for g in range(1, q + 1)],
    )


def with_returns(factors: list[DataFrame], keys: list[str], returns: list[str]) -> DataFrame:
    """OP-77: factor tables side by side on their keys; returns come from the first table, in their order, that has them."""
    out = factors[0]
    for df in factors[1:]:
        df = df.drop(*[c for c in df.columns if c in out.columns and c not in [*keys, *returns]])
        both = [c for c in returns if c in df.columns and c in out.columns]
        df = df.withColumnsRenamed({c: f"_later_{c}" for c in both})
        out = out.join(df, keys, "full").withColumns({c: F.coalesce(c, f"_later_{c}") for c in both}).drop(*[f"_later_{c}" for c in both])
    return out
