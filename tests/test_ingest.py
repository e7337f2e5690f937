from pyspark.sql import functions as F

from tickweave.operators import ingest as I
from tickweave.operators.base import five_levels, with_base, with_forward_returns
from tickweave.sources.schemas import BOOK

SESSIONS = (("09:30:00", "11:30:00"), ("13:00:00", "14:57:00"))


def test_grid_f01(spark):
    rows = I.session_grid(spark.createDataFrame([("20240102",)], "day string"), SESSIONS, "3 seconds").selectExpr("tick_idx", "date_format(ts, 'HH:mm:ss') t").collect()
    assert len(rows) == 4740 and rows[2399].t == "11:29:57" and rows[2400].t == "13:00:00" and rows[-1].t == "14:56:57"


def test_times_f04(spark):
    df = spark.createDataFrame([("9:30:01",), (" 09:30:01.23 ",), ("24:00:00",), ("nan",), ("",), ("93001",), (None,)], "t string")
    got = [r[0] for r in df.select(I.parse_time(F.lit("20240102"), F.col("t"))).collect()]
    assert got[0].second == 1 and got[1].microsecond == 230000 and got[2:] == [None] * 5


def test_keep_last_f05(spark):
    df = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 11, 3, "c")], "s int, ts int, file_line int, v string")
    assert sorted(r.v for r in I.keep_last(df, ["s", "ts"], F.col("file_line")).collect()) == ["b", "c"]


def test_as_of_f02_f03(spark):
    stamp = lambda n: F.timestamp_seconds(F.col(n)).cast("timestamp_ntz")
    grid = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 5)], "s int, g int").select("s", stamp("g").alias("at"), "g")
    ticks = spark.createDataFrame([(1, 2, "a", 1.0), (1, 5, "b", 2.0), (1, 6, "c", None)], "s int, t int, v string, bid double").select("s", stamp("t").alias("ts"), "v", "bid")
    rows = {(r.s, r.g): (r.v, r.bid, r.gap_sec) for r in I.as_of(grid, ticks, ["s"], "at", "ts").collect()}
    assert rows == {(1, 1): (None, None, None), (1, 5): ("b", 2.0, 0.0), (1, 9): ("c", None, 3.0), (2, 5): (None, None, None)}


def test_status_f06(spark):
    cases = [("SH", "TRADE", "Trade"), ("SH", "OCALL", "Auction"), ("SH", "HALT", "Suspend"), ("SZ", "T0", "Trade"), ("SZ", "T1", "Suspend"), ("SZ", "O0", "Auction"),
             ("SZ", "C0", "Auction"), ("SZ", "H0", "Suspend"), ("SZ", "B0", "Suspend"), ("SZ", None, "Suspend"), ("SZ", "T", "Trade"), ("SH", " TRADE ", "Trade"), ("SZ", "O1", "Suspend")]
    df = spark.createDataFrame(cases, "m string, s string, want string")
    for r in df.select("want", I.tick_class(F.col("m"), F.col("s")).alias("got")).collect():
        assert r.got == r.want + "Like"


def test_overrides_f07_and_decisions(spark):
    days = spark.createDataFrame([(d, s, 5, q) for d in ("20240102", "20240103") for s, q in (("000001", False), ("300001", True), ("600001", False), ("600002", True))], "day string, security_id string, rows long, all_suspended boolean")
    hit = lambda listed, **k: {(r.day[-1], r.security_id) for r in I.expand_overrides(days, spark.createDataFrame(listed, "day string, security string, reason string"), **k).filter("overridden").collect()}
    assert hit([("20240102", "ALL_SZ", "")]) == {("2", "000001"), ("2", "300001")}
    assert hit([("20240102", "ALL_SH", "")]) == {("2", "600001"), ("2", "600002")}
    assert len(hit([("20240102", "ALL", "")])) == 4 and hit([("20240103", "1", "")]) == {("3", "000001")}
    assert hit([("ALL", "600001", "")]) == {("2", "600001"), ("3", "600001")} and hit([("ALL", "600001", "")], all_dates=False) == set()  # D-01
    lists = spark.createDataFrame([("20240102", "300001", "x")], "day string, security string, reason string")
    decided = I.drop_decision(I.expand_overrides(days, lists))
    reasons = {(r.day[-1], r.security_id): r.drop_reason for r in decided.collect()}
    assert reasons["2", "300001"] == "MANUAL_OVERRIDE" and reasons["3", "300001"] == "ALL_DAY_SUSPEND" and reasons["2", "000001"] is None
    assert [(r.drop_reason, r.n) for r in I.reason_counts(decided).collect()] == [("ALL_DAY_SUSPEND", 3), ("MANUAL_OVERRIDE", 1)]
    assert I.keep_days(days, decided, ["day", "security_id"]).count() == 4 and I.dropped_report(decided, ["day", "security_id"]).count() == 4


def book(**changes):
    row = {f"{s}{w}{i}": (10 + (0.02 if s == "Ask" else 0) + (i - 1) * (0.01 if s == "Ask" else -0.01)) if w == "Price" else 100.0 for s in ("Ask", "Bid") for w in ("Price", "Volume") for i in range(1, 6)}
    row.update(changes)
    return tuple(row[c] for c in BOOK)


def test_prices_f08_to_f10(spark):
    gone = {f"{s}{w}1": None for s in ("Bid",) for w in ("Price", "Volume")}
    no_ask = {"AskPrice1": None, "AskVolume1": None}
    cases = [("mid", "TRADE", book(BidVolume1=200.0)), ("down", "TRADE", book(**gone)), ("up", "TRADE", book(**no_ask)), ("crossed", "TRADE", book(BidPrice1=11.0)), ("none", "TRADE", book(**gone, **no_ask)),
             ("halt", "HALT", book()), ("level5", "TRADE", book(BidPrice5=0.0)), ("hole", "TRADE", book(BidPrice5=None))]
    df = spark.createDataFrame([(n, "SH", s, *b) for n, s, b in cases], "n string, market string, status string, " + ", ".join(f"{c} double" for c in BOOK))
    rows = {r.n: r for r in with_base(df).collect()}
    assert abs(rows["mid"].Price - (10 * 100 + 10.02 * 200) / 300) < 1e-12 and rows["mid"].PriceType == "NORMAL_WMID"
    assert (rows["down"].PriceType, rows["down"].Price) == ("LIMIT_DOWN_ONE_SIDED", 10.02) and (rows["up"].PriceType, rows["up"].Price) == ("LIMIT_UP_ONE_SIDED", 10.0)
    for n in ("crossed", "none", "halt"):
        assert rows[n].PriceType == "INVALID" and rows[n].Price is None and not rows[n].CanUsePrice
    assert rows["level5"].CanUseFiveLevelBook and rows["hole"].CanUseDoubleSideBook and not rows["hole"].CanUseFiveLevelBook
    assert df.select(five_levels().alias("x")).count() == len(cases)


def test_forward_returns(spark):
    df = spark.createDataFrame([("d", "s", i, p, p is not None) for i, p in enumerate([1.0, 2.0, None, 4.0])], "date string, security_id string, tick_idx int, Price double, CanUsePrice boolean")
    out = with_forward_returns(df, (1, 2), ["date", "security_id"], "tick_idx").orderBy("tick_idx").collect()
    assert [r.ret_fwd_1 for r in out] == [1.0, None, None, None] and [r.ret_fwd_2 for r in out] == [None, 1.0, None, None]


def test_raw_ticks_are_read_and_dealt_once(spark):
    """One scan and one exchange, whatever the grid; values that are not wanted are left out."""
    raw = spark.createDataFrame(
        [("20240102", "000001", t, n, p, "SZ", None) for n, (t, p) in enumerate([("09:30:05", 1.0), ("09:30:05", 2.0), ("09:30:09", None), ("nan", 9.0)])] + [("20240230", "000001", "09:30:00", 0, 1.0, "SZ", None)],
        "day string, security_id string, UpdateTime string, file_line long, LastPrice double, market string, lacks string",
    )
    sampled = I.sample_ticks(raw, (("09:30:00", "09:30:12"),), "3 seconds", ["LastPrice"])
    rows = sorted((r.tick_idx, r.sample_time, r.LastPrice, r.gap_sec, r.market) for r in sampled.collect())
    assert rows == [(0, "09:30:00", None, None, "SZ"), (1, "09:30:03", None, None, "SZ"), (2, "09:30:06", 2.0, 1.0, "SZ"), (3, "09:30:09", None, 0.0, "SZ")]
    plan = sampled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1, plan
