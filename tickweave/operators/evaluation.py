"""Information coefficients and their statistics (OP-55 to OP-64).

Panels are long: a row for each (date, time, security). One pass serves all factors and horizons, and sessions are split after the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.exprs import div, flag

TINY = 1e-12
Pairs = list[tuple[str, str]]  # (factor column, return column)


def _correlation(n: Column, sf: Column, sr: Column, cov: Column, squared: bool) -> Column:
    """Pearson from population moments; NULL where the deviations vanish. squared: the limit is on sqrt(SSf * SSr), else on sqrt(SSf) * sqrt(SSr)."""
    spread = F.sqrt((sf * sf * n) * (sr * sr * n)) if squared else F.sqrt(sf * sf * n) * F.sqrt(sr * sr * n)
    return F.when(spread > TINY, div(cov * n, spread))


def _pearson(f: Column, r: Column, squared: bool = False) -> Column:
    """As an aggregate over the rows where both are there. corr() would raise for groups without spread."""
    both = f.isNotNull() & r.isNotNull()
    f, r = F.when(both, f.cast("double")), F.when(both, r.cast("double"))
    return _correlation(F.count(f), F.stddev_pop(f), F.stddev_pop(r), F.covar_pop(f, r), squared)


def cs_ic(panel: DataFrame, pairs: Pairs, at: list[str], security: str, tasks: int | None = None) -> DataFrame:
    """OP-55, OP-56: (at, ret, factor_col, ic, rankic), a row for each cross-section and pair.

    Ranks are ordinal, ties by security; each of factor and return is ranked among its own values, before the pairs are matched.
    tasks: how many the cross-sections are dealt to, if not as many as the session says.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(W.partitionBy(*at).orderBy(F.col(c).asc_nulls_last(), security)))
    narrow = panel.select(*at, security, *columns)
    ranked = (narrow.repartition(tasks, *at) if tasks else narrow).withColumns({f"_rank_{c}": rank(c) for c in columns})
    aggs = []
    for k, (f, r) in enumerate(pairs):
        aggs += [_pearson(F.col(f), F.col(r)).alias(f"_ic{k}"), _pearson(F.col(f"_rank_{f}"), F.col(f"_rank_{r}")).alias(f"_rankic{k}")]
    wide = ranked.groupBy(*at).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r).alias("ret"), F.lit(f).alias("factor_col"), F.col(f"_ic{k}").alias("ic"), F.col(f"_rankic{k}").alias("rankic")) for k, (f, r) in enumerate(pairs)])
    return wide.select(*at, F.inline(rows))


def with_session(df: DataFrame, time: str, am_end: str, pm_start: str) -> DataFrame:
    """OP-57: each row for session all and, by its time, am or pm."""
    half = F.when(F.col(time) <= am_end, "am").when(F.col(time) >= pm_start, "pm")
    return df.withColumn("session", F.explode(F.array_compact(F.array(F.lit("all"), half))))


def cs_daily(ic: DataFrame, date: str, keys: list[str]) -> DataFrame:
    """OP-58: daily means."""
    return ic.groupBy(date, *keys).agg(F.avg("ic").alias("ic"), F.avg("rankic").alias("rankic"))


def ts_ic(panel: DataFrame, pairs: Pairs, by: list[str], time: str, sessions: tuple[str, str] | None = None, tasks: int | None = None) -> DataFrame:
    """OP-59, OP-60: (by, [session,] ret, factor_col, ts_ic, ts_rankic) over the rows of each of by. sessions: (end of am, start of pm), if wanted.

    Where a factor's {name}_has_limit holds its value doesn't count. Pairs are matched first, then ranked, ties by time; two rows are needed.
    The panel is dealt out once, wide, by `by` (to so many tasks, if not as many as the session says); rows for each session and pair are made, sorted and summed where they are.
    """
    masked = lambda f: F.when(~flag(F.col(f"{f}_has_limit")), F.col(f)) if f"{f}_has_limit" in panel.columns else F.col(f)
    factors, returns = (list(dict.fromkeys(names)) for names in zip(*pairs))
    wide = panel.select(*by, time, *[masked(f).cast("double").alias(f) for f in factors], *[F.col(r).cast("double").alias(r) for r in returns]).repartition(*([tasks] if tasks else []), *by)
    if sessions:
        wide, by = with_session(wide, time, *sessions), [*by, "session"]
    rows = F.array(*[F.struct(F.lit(r).alias("ret"), F.lit(f).alias("factor_col"), F.col(f).alias("f"), F.col(r).alias("r")) for f, r in pairs])
    keys = [*by, "ret", "factor_col"]
    long = wide.select(*by, time, F.inline(rows)).filter("f is not null and r is not null")
    rank = lambda c: F.row_number().over(W.partitionBy(*keys).orderBy(c, time))
    ranked = long.withColumns({"_rf": rank("f"), "_rr": rank("r")})
    enough = lambda v: F.when(F.count("*") >= 2, v)
    return ranked.groupBy(*keys).agg(
        enough(_pearson(F.col("f"), F.col("r"), True)).alias("ts_ic"), enough(_pearson(F.col("_rf"), F.col("_rr"), True)).alias("ts_rankic")
    )


def window_number(factor_col: Column, factor: Column | str) -> Column:
    """OP-63: the first whole number after the factor's name; 0 without one."""
    factor = F.lit(factor) if isinstance(factor, str) else factor
    digits = F.regexp_extract(F.substring(factor_col, F.length(factor) + F.lit(2), F.length(factor_col)), r"(\d+)", 1)
    return F.when(digits == "", 0).otherwise(digits.try_cast("int"))


def cs_stats(daily: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """OP-61: mean, deviation and their ratio over days. compat: the population deviation and one day more, as a stray file made them once."""
    spread = F.stddev_pop if compat else F.stddev_samp
    agg = daily.groupBy(*keys).agg(
        F.avg("ic").alias("ic_mean"), F.avg("rankic").alias("rankic_mean"),
        F.when(F.count("ic") > 1, spread("ic")).alias("ic_std"), F.when(F.count("rankic") > 1, spread("rankic")).alias("rankic_std"),
        (F.count("*") + int(compat)).alias("n_days"),
    )
    ratio = lambda m, s: F.when(F.col(s) > TINY, div(F.col(m), F.col(s)))
    return agg.withColumns({"icir": ratio("ic_mean", "ic_std"), "rankic_ir": ratio("rankic_mean", "rankic_std")})


def ts_stats(ic: DataFrame, date: str, security: str, keys: list[str]) -> DataFrame:
    """OP-62: each security's mean over days and mean over deviation (two days at least), then their means over securities."""
    ratio = lambda c: F.when((F.count(c) >= 2) & (F.stddev_pop(c) > TINY), div(F.avg(c), F.stddev_pop(c)))
    each = ic.groupBy(*keys, security).agg(
        F.avg("ts_ic").alias("m"), F.avg("ts_rankic").alias("rm"), ratio("ts_ic").alias("ir"), ratio("ts_rankic").alias("rir")
    )
    days = ic.groupBy(*keys).agg(F.countDistinct(date).alias("n_days")).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = each.groupBy(*keys).agg(
        F.avg("m").alias("ic_mean"), F.avg("rm").alias("rankic_mean"), F.avg("ir").alias("icir"), F.avg("rir").alias("rankic_ir"), F.count("*").alias("n_stocks")
    )
    condition = [F.col(k) == F.col(f"_{k}") for k in keys]
    return out.join(days, condition).select(*keys, "ic_mean", "rankic_mean", "icir", "rankic_ir", "n_days", "n_stocks")
