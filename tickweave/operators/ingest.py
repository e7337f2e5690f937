"""Resampling (OP-14 to OP-21) and screening (OP-22 to OP-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.exprs import flag


# ---- resampling


def iso_day(day: Column) -> Column:
    """yyyymmdd as yyyy-mm-dd."""
    return F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))


def parse_time(day: Column, time: Column) -> Column:
    """OP-15: yyyymmdd and HH:MM:SS[.f] as a timestamp without zone; NULL where the time is none."""
    iso = iso_day(day)
    clean = F.trim(time)
    return F.when(F.contains(clean, F.lit(":")), F.concat_ws(" ", iso, clean).try_cast("timestamp_ntz"))


def session_times(sessions: tuple[tuple[str, str], ...], freq: str, day_col: str = "day") -> Column:
    """OP-14: the grid times of a day (yyyymmdd), left-closed and right-open, in order."""
    parts = []
    for begin, end in sessions:
        last = parse_time(F.col(day_col), F.lit(end)) - F.expr(f"interval {freq}")
        parts.append(F.sequence(parse_time(F.col(day_col), F.lit(begin)), last, F.expr(f"interval {freq}")))
    return F.concat(*parts)


def session_grid(days: DataFrame, sessions: tuple[tuple[str, str], ...], freq: str, day_col: str = "day") -> DataFrame:
    """OP-14: for each row of days (day yyyymmdd, ...) its grid times, numbered by tick_idx."""
    return days.select("*", F.posexplode(session_times(sessions, freq, day_col)).alias("tick_idx", "ts"))


def keep_last(ticks: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """OP-16: one row for each key, the last in the given order; Spark keeps only the last of each task before the exchange (WindowGroupLimit)."""
    last = W.partitionBy(*keys).orderBy(order.desc())
    return ticks.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def as_of(
    grid: DataFrame, ticks: DataFrame, by: list[str], grid_time: str = "ts", tick_time: str = "ts", gap: str = "gap_sec", columns: list[str] | None = None, tasks: int | None = None
) -> DataFrame:
    """OP-17, OP-18: each grid row with the last tick at or before it (or NULLs), and the seconds since.

    Both sides are put in one row of times and each grid row takes the latest tick as a whole, so a missing value of that tick stays
    missing. One exchange and one sort; no pairs of grid and tick are made. by is the partition, at will. columns: what is wanted of the tick
    (all by default); nothing else goes through the exchange, which no later projection could spare. tasks: how many the exchange deals to, if not as many as the session says.
    """
    carried = [c for c in ticks.columns if c not in by and (columns is None or c in columns or c == tick_time)]
    clash = [c for c in carried if c in grid.columns and c != tick_time]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    own = [c for c in grid.columns if c not in by]
    left = grid.select(*by, F.col(grid_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_grid"))
    right = ticks.select(*by, F.col(tick_time).alias("_at"), F.lit(0).alias("_side"), F.struct(*carried).alias("_tick"))
    both = left.unionByName(right, allowMissingColumns=True)
    return _latest(both.repartition(tasks, *by) if tasks else both, by, own, carried, tick_time, gap)


def _latest(both: DataFrame, by: list[str], own: list[str], carried: list[str], tick_time: str, gap: str) -> DataFrame:
    """Rows (by, _at, _side, _grid, _tick) of grid and ticks: each grid row (_side 1) with the last tick so far."""
    so_far = W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_last", F.last("_tick", ignorenulls=True).over(so_far)).filter("_side = 1")
    since = (F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col(f"_last.{tick_time}").cast("timestamp"))) / F.lit(1e6)
    values = [F.col(f"_last.{c}").alias("source_time" if c == tick_time else c) for c in carried]
    return found.select(*by, *[F.col(f"_grid.{c}").alias(c) for c in own], *values, since.alias(gap))


def sample_ticks(raw: DataFrame, sessions: tuple[tuple[str, str], ...], freq: str, columns: list[str] | None = None) -> DataFrame:
    """OP-14 to OP-20: raw ticks (day, security_id, UpdateTime, file_line, values) on the grid of their day; what a file says once (market, lacks) is on all its rows.

    Raw files are parsed once and dealt once: a file's first tick brings its grid. columns: the values wanted (all by default); no others are parsed.
    """
    by = ["day", "security_id"]
    of_file = [c for c in ("market", "lacks") if c in raw.columns]
    values = [c for c in raw.columns if c not in (*by, "Date", "file_line", *of_file) and (columns is None or c in columns)]
    timed = raw.withColumn("ts", parse_time(F.col("day"), F.col("UpdateTime"))).filter("ts is not null").select(*by, *of_file, *values, "ts", "file_line")
    ticks = keep_last(timed.repartition(*by), [*by, "ts"], F.col("file_line"))
    begins = F.row_number().over(W.partitionBy(*by, *of_file).orderBy("ts")) == 1
    grid = F.when(F.col("_begins"), F.transform(session_times(sessions, freq), lambda t, k: F.struct(k.alias("k"), t.alias("at"))))
    here = F.array(F.struct(F.lit(None).cast("int").alias("k"), F.col("ts").alias("at")))
    each = ticks.withColumn("_begins", begins).withColumn("_e", F.explode(F.coalesce(F.concat(here, grid), here)))
    of_grid = F.col("_e.k").isNotNull()
    both = each.select(
        *by, F.col("_e.at").alias("_at"), of_grid.cast("int").alias("_side"),
        F.when(of_grid, F.struct(*of_file, F.col("_e.k").alias("tick_idx"), F.col("_e.at").alias("grid_ts"))).alias("_grid"),
        F.when(~of_grid, F.struct(*values, "ts")).alias("_tick"),
    )
    sampled = _latest(both, by, [*of_file, "tick_idx", "grid_ts"], [*values, "ts"], "ts", "gap_sec")
    return sampled.select(iso_day(F.col("day")).alias("date"), F.date_format("grid_ts", "HH:mm:ss").alias("sample_time"), "*").drop("grid_ts", "source_time")


def raw_counts(raw: DataFrame) -> DataFrame:
    """(day, security_id, RawRows, untimed): the distinct times of each raw file that has rows, and whether it lacks the column of times."""
    times = raw.select("day", "security_id", parse_time(F.col("day"), F.col("UpdateTime")).alias("ts"), flag(F.col("lacks") == "UpdateTime").alias("untimed")).distinct()
    return times.groupBy("day", "security_id").agg(F.count("ts").alias("RawRows"), F.bool_or("untimed").alias("untimed"))


def file_status(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """(day, security_id, RawRows, Failed): every listed file (day, security_id, bytes); Failed says why it gives no ticks, NULL where it does.

    FAIL where reading it goes wrong: nothing in it, no column of times, a folder that is no day. NO_RAW_DATA: a header alone. NO_VALID_TIME: rows, but none with a time.
    """
    joined = listed.join(counts, ["day", "security_id"], "left")
    rows = F.coalesce("RawRows", F.lit(0))
    failed = (
        F.when(F.col("bytes") == 0, "FAIL: empty file")
        .when(F.col("RawRows").isNull(), "NO_RAW_DATA")
        .when(F.col("untimed"), "FAIL: no column UpdateTime")
        .when(iso_day(F.col("day")).try_cast("date").isNull(), "FAIL: no such day")
        .when(rows == 0, "NO_VALID_TIME")
    )
    return joined.select("day", "security_id", F.when(~flag(F.startswith(failed, F.lit("FAIL"))), rows).alias("RawRows"), failed.alias("Failed"))


def resample_summary(sampled: DataFrame, raw_rows: DataFrame, by: list[str], threshold: float = 60.0, gap: str = "gap_sec") -> DataFrame:
    """OP-21: one row for each of by; raw_rows (by, RawRows[, Failed]) counts the ticks left after parsing and deduplication, and may be 0.

    With Failed (as from file_status) every file has its row and its status, those that gave no ticks too; without, no rows mean NO_VALID_TIME.
    """
    agg = sampled.groupBy(*by).agg(
        F.count("*").alias("SampleRows"),
        F.bround(F.max(gap), 1).alias("MaxGapSec"),
        F.bround(F.avg(gap), 1).alias("MeanGapSec"),
        F.bround(F.avg(flag(F.col(gap) > threshold).cast("double")), 4).alias("PctGapGt60"),
        F.max(gap).alias("_max"),
    )
    told = "Failed" in raw_rows.columns
    failed = F.col("Failed") if told else F.when(F.coalesce("RawRows", F.lit(0)) == 0, "NO_VALID_TIME")
    rows = F.when(~flag(F.startswith(failed, F.lit("FAIL"))), F.coalesce("RawRows", F.lit(0)))
    sampled_rows = F.when(rows.isNotNull(), F.coalesce("SampleRows", F.lit(0)))
    status = F.coalesce(failed, F.when(F.col("_max") <= threshold, "OK").otherwise("LARGE_GAP"))
    return agg.join(raw_rows, by, "full").select(*by, rows.alias("RawRows"), sampled_rows.alias("SampleRows"), "MaxGapSec", "MeanGapSec", "PctGapGt60", status.alias("Status"))


# ---- screening


def tick_class(market: Column, status: Column) -> Column:
    """OP-22: TradeLike, AuctionLike or SuspendLike; a missing status is SuspendLike."""
    s = F.coalesce(F.trim(status), F.lit("nan"))
    sh = F.when(s == "TRADE", "TradeLike").when(s.isin("OCALL", "CCALL", "ICALL", "FCALL"), "AuctionLike")
    first = F.substring(s, 1, 1)
    sz = F.when(F.substring(s, 2, 1) == "1", "SuspendLike").when(first == "T", "TradeLike").when(first.isin("O", "C"), "AuctionLike")
    return F.coalesce(F.when(market == "SH", sh).when(market == "SZ", sz), F.lit("SuspendLike"))


def suspended_days(ticks: DataFrame, by: list[str], market: Column, status: Column) -> DataFrame:
    """OP-23: (by, all_suspended, rows[, failed]): whether a day has nothing but suspended ticks; without a status column (market UNK) it has not.

    failed, where ticks have a tick_idx: its numbers are not 0, 1, ... once each, so rows were lost or came twice.
    """
    quiet = (tick_class(market, status) == "SuspendLike") & ~flag(market == "UNK")
    checked = [(~ticks_in_order()).alias("failed")] if "tick_idx" in ticks.columns else []
    return ticks.groupBy(*by).agg(flag(F.bool_and(flag(quiet))).alias("all_suspended"), F.count("*").alias("rows"), *checked)


def ticks_in_order(order: str = "tick_idx") -> Column:
    """As an aggregate: whether the numbers of a day's ticks are 0, 1, ... once each, by their count, ends, sum and sum of squares."""
    n, k = F.count("*"), F.col(order).cast("long")
    return flag((F.count(k) == n) & (F.min(k) == 0) & (F.max(k) == n - 1) & (2 * F.sum(k) == n * (n - 1)) & (6 * F.sum(k * k) == n * (n - 1) * (2 * n - 1)))


def with_listed(days: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """OP-25: suspended days, and those that were sampled (by their status) but have no row: rows 0."""
    sampled = summary.filter(F.col("Status").isin("OK", "LARGE_GAP")).select(*by, F.replace("date", F.lit("-"), F.lit("")).alias("_day"))
    joined = days.join(sampled, by, "full")
    return joined.withColumns({"day": F.coalesce("day", "_day"), "rows": F.coalesce("rows", F.lit(0)), "all_suspended": flag(F.col("all_suspended")), "failed": flag(F.col("failed"))}).drop("_day")


def expand_overrides(days: DataFrame, overrides: DataFrame, all_dates: bool = True) -> DataFrame:
    """OP-24: days (day, security_id, ...) with overridden: by its id (zeros in front may be missing), ALL, ALL_SZ (ids from 0 or 3), ALL_SH (from 6).

    all_dates: whether ALL as a date means every day (the documents' meaning) or nothing (compatible with the old code).
    """
    ids = F.col("security_id")
    label = F.explode(F.array_compact(F.array(
        F.lit("ALL"), F.when(F.substring(ids, 1, 1).isin("0", "3"), "ALL_SZ"), F.when(F.substring(ids, 1, 1) == "6", "ALL_SH"), ids
    )))
    when = F.array(F.col("day"), F.lit("ALL")) if all_dates else F.array(F.col("day"))
    asked = days.select("day", "security_id", label.alias("_label"), when.alias("_when")).withColumn("_when", F.explode("_when"))
    wild = F.col("security").isin("ALL", "ALL_SZ", "ALL_SH")
    listed = overrides.select(F.col("day").alias("_when"), F.when(wild, F.col("security")).otherwise(F.lpad("security", 6, "0")).alias("_label"))
    hit = asked.join(listed.distinct(), ["_when", "_label"], "left_semi").select("day", "security_id").distinct().withColumn("overridden", F.lit(True))
    return days.join(hit, ["day", "security_id"], "left").withColumn("overridden", flag(F.col("overridden")))


def drop_decision(days: DataFrame) -> DataFrame:
    """OP-25: drop_reason of days (overridden, rows, all_suspended[, failed]), NULL for those kept; the first that holds counts, but what can't be read right is an ERROR before it is suspended."""
    failed = flag(F.col("failed")) if "failed" in days.columns else F.lit(False)
    reason = (
        F.when(F.col("overridden"), "MANUAL_OVERRIDE")
        .when(F.coalesce("rows", F.lit(0)) == 0, "EMPTY_FILE")
        .when(failed, "ERROR: ticks missing or repeated")
        .when(F.col("all_suspended"), "ALL_DAY_SUSPEND")
    )
    return days.withColumn("drop_reason", reason)


def keep_days(ticks: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """OP-25: the ticks of kept days."""
    return ticks.join(decided.filter("drop_reason is null"), by, "left_semi")


def dropped_report(decided: DataFrame, by: list[str]) -> DataFrame:
    """OP-26."""
    return decided.filter("drop_reason is not null").select(*by, "drop_reason").orderBy(*by)


def gap_review(decided: DataFrame, summary: DataFrame, by: list[str], threshold: float = 60.0) -> DataFrame:
    """OP-27: kept days whose largest gap exceeds the threshold."""
    kept = decided.filter("drop_reason is null").select(*by)
    return kept.join(summary.filter(F.col("MaxGapSec") > threshold).select(*by, "MaxGapSec"), by).orderBy(*by)


def reason_counts(decided: DataFrame) -> DataFrame:
    """OP-28."""
    dropped = decided.filter("drop_reason is not null")
    return dropped.groupBy("drop_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "drop_reason")
