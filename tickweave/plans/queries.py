"""A query for each operator, over the tables at hand. Floats leave rounded (exprs.tidy), so that engines can be compared."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.along import tasks_for
from tickweave.functions.exprs import tidy
from tickweave.operators import evaluation as E
from tickweave.operators import ingest as I
from tickweave.operators import quantiles as Q
from tickweave.operators import state as S
from tickweave.operators import views as V
from tickweave.operators.base import base_status, base_summary, with_base, with_forward_returns, with_status
from tickweave.operators.factors import FACTORS, bap_raw, factor_summary, mean_factors, ofd_raw, oir_raw, run_factor, ticks
from tickweave.plans import adapters as A
from tickweave.sources.readers import available_days, listed, parse_raw, read_factor_stats, read_metadata, read_overrides, read_table
from tickweave.sources.schemas import METADATA
from tickweave.sources.sinks import write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
T_WINDOWS = {"4t": 4, "6t": 6, "12t": 12}
AT = ["date", "sample_time"]
PAIRS = [(f, r) for f in A.FACTORS for r in A.RETURNS]


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- raw files, made of events


@query("raw_parse")
def _(spark, d):
    raw = parse_raw(A.raw_files(spark, d))
    return rounded(raw.select("day", "security_id", "file_line", "Date", "UpdateTime", "LastPrice", "PreCloPrice", "volume", "status", "market", "AskPrice1", "BidVolume5"))


@query("raw_times")
def _(spark, d):
    raw = parse_raw(A.raw_files(spark, d))
    return raw.select("day", "security_id", "file_line", F.date_format(I.parse_time(F.col("day"), F.col("UpdateTime")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("raw_sampled")
def _(spark, d):
    sessions = (("09:30:00", "11:30:00"), ("13:00:00", "15:00:00"))
    sampled = I.sample_ticks(parse_raw(A.raw_files(spark, d)), sessions, "30 minutes", ["UpdateTime", "LastPrice", "volume", "status"])
    return rounded(sampled.select("date", "sample_time", "day", "security_id", "tick_idx", "UpdateTime", "LastPrice", "volume", "status", "market", "gap_sec"))


@query("raw_days")
def _(spark, d):
    """The days there are files for, by market."""
    raw = parse_raw(A.raw_files(spark, d))
    return available_days(raw.select(F.concat_ws(" ", "day", "market").alias("date")))


# ---- raw files some of which are broken

SESSIONS = (("09:30:00", "11:30:00"), ("13:00:00", "15:00:00"))


def _broken(spark, d, columns=None, written=False):
    """(ticks on the grid, summary): the sample stage over files of which six in nine are broken. columns: the values wanted of a tick. written: the ticks are written and read again, as the stage does."""
    files = A.broken_files(spark, d)
    raw = parse_raw(files)
    sampled = I.sample_ticks(raw, SESSIONS, "30 minutes", columns)
    if written:
        folder = f"{_scratch(spark)}/sampled"
        sampled.write.parquet(folder)
        sampled = spark.read.schema(sampled.schema).parquet(folder)
    status = I.file_status(listed(files.select("path", F.length("content").alias("bytes"))), I.raw_counts(raw))
    rows = status.withColumn("date", I.iso_day(F.col("day"))).drop("day")
    return sampled, I.resample_summary(sampled, rows, KEYS, 36000.0)


KEYS = ["date", "security_id"]


@query("raw_report")
def _(spark, d):
    """A status for every file, those that give no ticks too."""
    return rounded(_broken(spark, d, [])[1])


@query("raw_base")
def _(spark, d):
    """Prices and masks of both markets, from the files that have what it takes."""
    sampled = _broken(spark, d)[0]
    good = base_status(sampled, KEYS).filter("Status = 'OK'").select(*KEYS, "market")
    base = with_base(sampled.drop("market").join(good, KEYS))
    return rounded(base.select(*KEYS, "sample_time", "market", "PriceType", "Price", "CanUsePrice", "CanUseDoubleSideBook", "CanUseFiveLevelBook"))


@query("raw_base_report")
def _(spark, d):
    """A status for every security and day with ticks, and the counts of those that don't fail."""
    sampled = _broken(spark, d)[0]
    statuses = base_status(sampled, KEYS)
    base = with_base(sampled.drop("market").join(statuses.filter("Status = 'OK'").select(*KEYS, "market"), KEYS))
    return with_status(base_summary(base, KEYS), statuses, KEYS)


@query("raw_screen_report")
def _(spark, d):
    """Days that lost all their rows, or have some twice, since they were sampled."""
    sampled, summary = _broken(spark, d, ["status"], written=True)
    fate = (F.substring("day", 7, 2).cast("int") + 2 * F.col("security_id").cast("int")) % 11
    left = sampled.filter(fate != 0).withColumn("_", F.explode(F.when((fate == 1) & (F.col("tick_idx") == 3), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_")
    days = I.suspended_days(left, [*KEYS, "day"], F.col("market"), F.col("status"))
    decided = I.drop_decision(I.with_listed(days, summary, KEYS).withColumn("overridden", F.lit(False)))
    return decided.select(*KEYS, "day", "rows", "drop_reason")


# ---- sources and sinks, by way of files


def _scratch(spark) -> str:
    """A new folder where the session says that all can write; on one machine without such a setting, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/tables-{uuid.uuid4().hex}"


@query("table_rerun")
def _(spark, d):
    """A table of events by day; then some days again, of which some have no rows any more: nothing old of these stays, and the others are whole."""
    root, day = _scratch(spark), F.date_format("ts", "yyyy-MM-dd")
    events = A.table(spark, d, "events").select(day.alias("date"), "event_id", "user_id", "value")
    write_table(events, root, "t")
    again = [f"2024-01-{k:02d}" for k in range(8, 23)]
    fewer = events.filter((F.col("value") > 20) & (F.substring("date", 9, 2) % 5 != 0)).drop("user_id")
    write_table(fewer, root, "t", covers=again)
    return rounded(read_table(spark, root, "t"))


@query("table_without_rows")
def _(spark, d):
    """An empty table has its columns, and takes rows afterwards."""
    root, n = _scratch(spark), A.table(spark, d, "nation")
    write_table(n.filter("n_nationkey < 0"), root, "t", ["n_name"])
    none = read_table(spark, root, "t")
    write_table(n.filter("n_regionkey = 1"), root, "t", ["n_name"], [r.n_name for r in n.select("n_name").collect()])
    return read_table(spark, root, "t").unionByName(none).select("n_nationkey", "n_name", "n_regionkey")


@query("factor_stats")
def _(spark, d):
    """The statistics of two factors, each written by itself, read together; the first one twice."""
    root, stats = _scratch(spark), _stats(spark, d)
    for name, columns in (("alpha", ["alpha_1m", "alpha_2m"]), ("gamma", ["alpha_3m"]), ("alpha", ["alpha_1m"])):
        write_table(stats.filter(F.col("factor_col").isin(columns)).withColumn("factor_name", F.lit(name)), root, "cs_ic_stats", ["factor_name"], [name])
    return rounded(read_factor_stats(spark, root).select("factor_name", "ret", "session", "factor_col", "ic_mean", "n_days"))


@query("override_list")
def _(spark, d):
    path, n = _scratch(spark), A.table(spark, d, "nation")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("# "), "n_name")).when(F.col("n_nationkey") % 7 == 0, "").when(F.col("n_nationkey") % 11 == 0, "Date,SecurityID,Reason")
    listed_days = F.concat_ws(",", F.concat(F.lit(" 202401"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    n.select(F.coalesce(line, listed_days)).write.text(path)
    return read_overrides(spark, path)


@query("factor_metadata")
def _(spark, d):
    """Descriptions with quotes, commas and lines of their own, by way of a file; then searched."""
    path, p = _scratch(spark), A.table(spark, d, "part")
    told = F.concat(F.lit('a "'), "p_name", F.lit('",\nof '), "p_type")
    columns = {"factor_name": F.col("p_partkey").cast("string"), "full_name": F.col("p_name"), "category": F.col("p_brand"), "description": told}
    names = METADATA.names
    p.select(*[columns.get(c, F.lit("-")).alias(c) for c in names]).write.csv(path, header=True, quote='"', escape='"')
    return V.search(read_metadata(spark, path), "brand#1.*|steel").select("factor_name", "full_name", "category", "description", "notes")


@query("returns_source")
def _(spark, d):
    """Factor tables of different days side by side: returns from the first that has them."""
    p = A.panel(spark, d)
    early, late = p.filter("date < '1996'"), p.filter("date >= '1994'")
    tables = [early.select(*AT, "security_id", "ret_1", "alpha_1m"), late.select(*AT, "security_id", (F.col("ret_1") + 1).alias("ret_1"), "alpha_2m")]
    return rounded(Q.with_returns(tables, [*AT, "security_id"], ["ret_1"]))


# ---- ingest, on events


@query("resample_grid")
def _(spark, d):
    grid = A.hourly_grid(A.event_ticks(spark, d))
    return grid.select("security_id", F.date_format("grid_ts", "yyyy-MM-dd HH:mm:ss").alias("grid_ts"))


@query("session_grid")
def _(spark, d):
    days = A.event_ticks(spark, d).select(F.date_format("ts", "yyyyMMdd").alias("day")).distinct()
    grid = I.session_grid(days, (("09:30:00", "11:30:00"), ("13:00:00", "14:57:00")), "3 seconds")
    return grid.groupBy("day").agg(F.count("*").alias("ticks"), F.max("tick_idx").alias("last_idx"), F.date_format(F.min("ts"), "HH:mm:ss").alias("first"), F.date_format(F.max("ts"), "HH:mm:ss").alias("last"))


@query("keep_last")
def _(spark, d):
    t = A.table(spark, d, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    last = I.keep_last(t, ["user_id", "hour"], F.struct("ts", "event_id"))
    return rounded(last.select("user_id", "hour", "event_id", "value"))


@query("as_of_join")
def _(spark, d):
    s = A.sampled_events(spark, d, ["event_id", "value", "BidPrice1", "AskVolume3"])
    return rounded(s.select("security_id", "date", "sample_time", "tick_idx", "event_id", "value", "BidPrice1", "AskVolume3", "gap_sec"))


@query("resample_summary")
def _(spark, d):
    raw = A.event_ticks(spark, d).groupBy("security_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("RawRows"))
    return rounded(I.resample_summary(A.sampled_events(spark, d, []), raw, ["security_id", "date"], 36000.0))


def _statuses(spark, d):
    """Events as ticks of both markets, with each market's kind of status."""
    e = A.table(spark, d, "events")
    sz = F.element_at(F.array(*map(F.lit, ["T0", "T1", "O0", "C0", "H0"])), (F.col("event_id") % 5 + 1).cast("int"))
    sh = F.element_at(F.array(*map(F.lit, ["TRADE", "OCALL", "HALT", " TRADE "])), (F.col("event_id") % 4 + 1).cast("int"))
    market = F.when(F.col("user_id") % 2 == 0, "SZ").otherwise("SH")
    return e.select("event_id", F.lpad(F.col("user_id").cast("string"), 6, "0").alias("security_id"), F.date_format("ts", "yyyyMMdd").alias("day"), market.alias("market"), F.when(market == "SZ", sz).otherwise(sh).alias("status"))


@query("tick_status")
def _(spark, d):
    return _statuses(spark, d).select("event_id", I.tick_class(F.col("market"), F.col("status")).alias("tick_class"))


def _decided(spark, d):
    ticks = _statuses(spark, d)
    days = I.suspended_days(ticks, ["day", "security_id"], F.col("market"), F.col("status"))
    lists = A.table(spark, d, "nation").select(  # an override list made of the nations' keys
        F.when(F.col("n_nationkey") % 4 == 0, "ALL").otherwise(F.concat(F.lit("202401"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))).alias("day"),
        F.when(F.col("n_nationkey") % 9 == 1, "ALL_SZ").otherwise(F.col("n_nationkey").cast("string")).alias("security"),
        F.lit("listed").alias("reason"),
    )
    return ticks, I.drop_decision(I.expand_overrides(days, lists))


@query("screen_days")
def _(spark, d):
    return _decided(spark, d)[1].select("day", "security_id", "rows", "all_suspended", "overridden", "drop_reason")


@query("screen_kept_ticks")
def _(spark, d):
    ticks, decided = _decided(spark, d)
    return I.keep_days(ticks, decided, ["day", "security_id"]).select("event_id", "day", "security_id")


@query("screen_dropped")
def _(spark, d):
    return I.dropped_report(_decided(spark, d)[1], ["day", "security_id"])


@query("screen_reason_counts")
def _(spark, d):
    return I.reason_counts(_decided(spark, d)[1])


@query("gap_review")
def _(spark, d):
    raw = A.event_ticks(spark, d).groupBy("security_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("RawRows"))
    summary = I.resample_summary(A.sampled_events(spark, d, []), raw, ["security_id", "date"], 36000.0)
    reason = F.when(F.col("security_id") % 3 == 0, "MANUAL_OVERRIDE")
    return rounded(I.gap_review(summary.select("security_id", "date", reason.alias("drop_reason")), summary, ["security_id", "date"], 36000.0))


# ---- base, on events


@query("base_ticks")
def _(spark, d):
    return rounded(A.event_base(spark, d).select("security_id", *AT, "PriceType", "Price", "CanUsePrice", "CanUseDoubleSideBook", "CanUseFiveLevelBook"))


@query("base_summary")
def _(spark, d):
    return base_summary(A.event_base(spark, d), ["security_id", "date"])


@query("forward_returns")
def _(spark, d):
    out = with_forward_returns(A.event_base(spark, d), (1, 2, 3), list(A.DAY), A.ORDER)
    return rounded(out.select("security_id", *AT, "ret_fwd_1", "ret_fwd_2", "ret_fwd_3"))


# ---- factors, on events and line items


def _events_factor(name: str, windows: dict, **options) -> Query:
    def run(spark, d):
        base = A.event_base(spark, d)
        out = run_factor(base, name, A.DAY, A.ORDER, windows, keep=["sample_time"], placed=True, **options)
        return rounded(out.select("security_id", *AT, *[c for c in out.columns if c not in base.columns]))

    return run


def _items_factor(name: str, windows: dict, digits: int = 6, **options) -> Query:
    def run(spark, d):
        base = A.item_base(spark, d)
        out = run_factor(base, name, A.DAY, A.ORDER, windows, keep=[], placed=True, **options)
        return rounded(out.select("security_id", "tick_idx", *[c for c in out.columns if c not in base.columns]), digits)

    return run


for _name in ("bap", "oir", "ofd", "mom", "rsrs"):
    QUERIES[f"factor_{_name}"] = _events_factor(_name, T_WINDOWS)
QUERIES["factor_acc_mom"] = _events_factor("acc_mom", {"2_4t": (2, 4), "4_8t": (4, 8)})
QUERIES["factor_mom_items"] = _items_factor("mom", ticks(20, 120))
QUERIES["factor_amp_slice"] = _items_factor("amp_slice", ticks(60, 120, 300))
QUERIES["factor_rigidity"] = _items_factor("rigidity", ticks(20, 60))
QUERIES["factor_neg_skew"] = _items_factor("neg_skew", ticks(40, 100), lag=1)
QUERIES["factor_pv_corr"] = _items_factor("pv_corr", ticks(10, 20))


#: Windows as shipped (in rows); of the costliest factors the shortest, one between and the longest.
SHIPPED = {
    **{name: FACTORS[name].windows for name in ("bap", "oir", "ofd", "mom", "acc_mom", "rsrs", "neg_skew", "pv_corr")},
    "amp_slice": {k: FACTORS["amp_slice"].windows[k] for k in ("300t", "900t", "1500t")},
    "rigidity": {k: FACTORS["rigidity"].windows[k] for k in ("10m", "105m")},
}


def _shipped_factor(name: str) -> Query:
    def run(spark, d):
        base = A.long_base(spark, d)
        tasks = tasks_for(spark, A.table(spark, d, "lineitem").count())
        out = run_factor(base, name, A.DAY, A.ORDER, SHIPPED[name], keep=[], tasks=tasks)
        return rounded(out.select("security_id", "tick_idx", *[c for c in out.columns if c not in base.columns]))

    return run


for _name in SHIPPED:
    QUERIES[f"factor_{_name}_shipped"] = _shipped_factor(_name)


@query("factor_summary")
def _(spark, d):
    return factor_summary(run_factor(A.event_base(spark, d), "bap", A.DAY, A.ORDER, T_WINDOWS, keep=[], placed=True), "bap")


@query("factor_chain")
def _(spark, d):
    """Several factors in one pass: how many values each has."""
    raws = {"bap": bap_raw(), "oir": oir_raw(), "ofd": ofd_raw()}
    df = mean_factors(A.event_base(spark, d), raws, {"4t": 4}, A.DAY, A.ORDER, keep=[], placed=True)
    return df.groupBy("security_id").agg(*[F.count(f"{n}_4t").alias(f"nnz_{n}") for n in ("bap", "oir", "ofd")], *[F.count_if(f"{n}_4t_has_limit").alias(f"limits_{n}") for n in ("bap", "oir", "ofd")])


@query("pressure_ic")
def pressure_ic(spark, d):
    """Daily mean cross-sectional coefficient of book pressure against the next tick's return."""
    base = with_forward_returns(A.event_base(spark, d), (1,), list(A.DAY), A.ORDER)
    out = run_factor(base, "bap", A.DAY, A.ORDER, {"4t": 4}, keep=["sample_time", "ret_fwd_1"], placed=True)
    ic = E.cs_ic(out, [("bap_4t", "ret_fwd_1")], AT, "security_id", A.event_tasks(spark, d))
    daily = ic.groupBy("date").agg(F.avg("ic").alias("ic"), F.count("ic").alias("n"))
    return rounded(daily)


# ---- evaluation, on the panel


def _ic(spark, d):
    return E.cs_ic(A.panel(spark, d), PAIRS, AT, "security_id")


def _daily(spark, d):
    return E.cs_daily(E.with_session(_ic(spark, d), "sample_time", A.AM_END, A.PM_START), "date", ["ret", "session", "factor_col"])


def _stats(spark, d, compat=False):
    stats = E.cs_stats(_daily(spark, d), ["ret", "session", "factor_col"], compat)
    return stats.withColumns({"factor_name": F.lit("alpha"), "factor_window": E.window_number(F.col("factor_col"), "alpha")})


def _ts(spark, d):
    items = A.table(spark, d, "lineitem").count()  # at least as many as the panel's rows
    return E.ts_ic(A.panel(spark, d), PAIRS, ["date", "security_id"], "sample_time", (A.AM_END, A.PM_START), tasks_for(spark, items))


QUERIES["cs_ic"] = lambda spark, d: rounded(_ic(spark, d))
QUERIES["cs_daily_trend"] = lambda spark, d: rounded(_daily(spark, d))
QUERIES["cs_ic_stats"] = lambda spark, d: rounded(_stats(spark, d))
QUERIES["cs_ic_stats_compat"] = lambda spark, d: rounded(_stats(spark, d, True))
QUERIES["ts_ic"] = lambda spark, d: rounded(_ts(spark, d))
QUERIES["ts_ic_stats"] = lambda spark, d: rounded(E.ts_stats(_ts(spark, d), "date", "security_id", ["ret", "session", "factor_col"]))


@query("cs_ic_sessions")
def _(spark, d):
    return rounded(E.with_session(_ic(spark, d), "sample_time", A.AM_END, A.PM_START))


# ---- a day added to what is known of those before


STAT_KEYS = ["ret", "session", "factor_col"]
LAST = "2001"  # the panel's days are years


def _state(spark, df, keys, values, root, name):
    """What days before the last ones leave behind, read back from its table, and the state of the last ones."""
    write_table(S.state_of(df.filter(F.col("date") < LAST), keys, values, "date"), root, name, [])
    return S.merged(read_table(spark, root, name), S.state_of(df.filter(F.col("date") >= LAST), keys, values, "date"), keys, values)


@query("cs_ic_stats_added")
def _(spark, d):
    stats = S.cs_stats(_state(spark, _daily(spark, d), STAT_KEYS, ["ic", "rankic"], _scratch(spark), "cs"), STAT_KEYS)
    return rounded(stats.withColumns({"factor_name": F.lit("alpha"), "factor_window": E.window_number(F.col("factor_col"), "alpha")}))


@query("ts_ic_stats_added")
def _(spark, d):
    root, ic = _scratch(spark), _ts(spark, d)
    each = _state(spark, ic, [*STAT_KEYS, "security_id"], ["ts_ic", "ts_rankic"], root, "ts")
    days = _state(spark, ic, STAT_KEYS, [], root, "days")
    return rounded(S.ts_stats(each, days, STAT_KEYS, "security_id"))


@query("quantile_cum_daily_added")
def _(spark, d):
    """The curve of the days before, read back from its table, with the last day put on top of it."""
    root, b = _scratch(spark), _buckets(spark, d)
    write_table(Q.cumulative_days(b.filter(F.col("date") < LAST), "date"), root, "curve", [])
    before = read_table(spark, root, "curve")
    day = S.totals_of(b.filter(F.col("date") == LAST), ["factor_col"], Q.groups(5), "g5", "date")
    return rounded(before.unionByName(S.continued(day, before, ["factor_col"], Q.groups(5), "date")))


# ---- quantiles


def _buckets(spark, d):
    return Q.bucket_returns(A.panel(spark, d), A.FACTORS, "ret_1", AT, "security_id")


def _cum(spark, d):
    b = _buckets(spark, d)
    return Q.cumulative_ticks(b, "date", "sample_time"), Q.cumulative_days(b, "date")


@query("quantile_buckets")
def _(spark, d):
    p = A.panel(spark, d)
    return p.select(*AT, "security_id", *[Q.bucket_of(f, AT, "security_id", 5).alias(f"bucket_{f}") for f in A.FACTORS])


QUERIES["quantile_returns"] = lambda spark, d: rounded(_buckets(spark, d))
QUERIES["quantile_daily"] = lambda spark, d: rounded(Q.daily_means(_buckets(spark, d), "date"))
QUERIES["quantile_summary"] = lambda spark, d: rounded(Q.overall_means(Q.daily_means(_buckets(spark, d), "date")))
QUERIES["quantile_cum_tick"] = lambda spark, d: rounded(_cum(spark, d)[0])
QUERIES["quantile_cum_daily"] = lambda spark, d: rounded(_cum(spark, d)[1])
QUERIES["quantile_stitched"] = lambda spark, d: rounded(Q.stitched_ticks(*_cum(spark, d), "date", "sample_time"))


@query("quantile_chart")
def _(spark, d):
    curve = Q.stitched_ticks(*_cum(spark, d), "date", "sample_time")
    return rounded(Q.chart_curve(curve, "date", "sample_time").select("factor_col", *AT, "x", "month_start", "long_short"))


# ---- composites


def _weights(spark, d):
    return Q.ic_weights(_stats(spark, d), 0.001)


def _scored(spark, d):
    # the weights are rounded, so that ranks of the composite don't hang on the last bits
    w = {k: round(v, 6) for k, v in Q.collected_weights(_weights(spark, d).filter("ret = 'ret_1'")).items()}
    p = A.panel(spark, d)
    scored = Q.composite(p, w, AT, "security_id") if w else p.withColumn("composite", F.lit(None).cast("double"))
    return scored.withColumn("composite", tidy(F.col("composite")))


def _deciles(spark, d):
    return Q.composite_deciles(_scored(spark, d), "ret_1", AT, "security_id").withColumn("factor_col", F.lit("composite"))


QUERIES["composite_weights"] = lambda spark, d: rounded(_weights(spark, d))
QUERIES["composite_score"] = lambda spark, d: _scored(spark, d).select(*AT, "security_id", "composite")
QUERIES["composite_deciles"] = lambda spark, d: rounded(_deciles(spark, d))
QUERIES["composite_daily"] = lambda spark, d: rounded(Q.daily_means(_deciles(spark, d), "date", 10))
QUERIES["composite_summary"] = lambda spark, d: rounded(Q.overall_means(Q.daily_means(_deciles(spark, d), "date", 10), 10))
QUERIES["composite_cum_tick"] = lambda spark, d: rounded(Q.cumulative_ticks(_deciles(spark, d), "date", "sample_time", 10))
QUERIES["composite_cum_daily"] = lambda spark, d: rounded(Q.cumulative_days(_deciles(spark, d), "date", 10, "g1"))


@query("percentile_score")
def _(spark, d):
    p = A.panel(spark, d)
    return rounded(p.select(*AT, "security_id", *[Q.percentile_score(f, AT, "security_id").alias(f"score_{f}") for f in A.FACTORS]))


# ---- views


QUERIES["view_available_dates"] = lambda spark, d: V.available(A.panel(spark, d), "date")
QUERIES["view_ic_summary"] = lambda spark, d: rounded(V.ic_summary(_stats(spark, d), "ret_1", "am", "alpha"))
QUERIES["view_ic_trend"] = lambda spark, d: rounded(V.trend(_daily(spark, d), "alpha_2m", "date", session="all", ret="ret_1"))
QUERIES["view_quantile_day"] = lambda spark, d: rounded(V.trend(_buckets(spark, d), "alpha_1m", "sample_time", date="1997"))
QUERIES["view_plot_lines"] = lambda spark, d: rounded(V.plot_lines(_stats(spark, d)))
QUERIES["view_monotonicity"] = lambda spark, d: rounded(V.monotonicity(_cum(spark, d)[1], "date"))
QUERIES["view_pnl"] = lambda spark, d: rounded(V.pnl_stats(_cum(spark, d)[1], "date"))
QUERIES["view_day_pnl"] = lambda spark, d: rounded(V.day_pnl(_cum(spark, d)[0], "date", "sample_time"))


@query("view_search")
def _(spark, d):
    return V.search(A.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "brand#1.*|steel")


@query("view_natural_order")
def _(spark, d):
    names = A.table(spark, d, "part").select("p_brand").distinct()
    return names.select("p_brand", V.natural_order(F.col("p_brand")).alias("number"), E.window_number(F.col("p_brand"), "Brand").alias("window"))
