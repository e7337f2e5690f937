import math

import pytest
from pyspark.sql import functions as F

from tickweave.operators import evaluation as E
from tickweave.operators import quantiles as Q
from tickweave.operators import views as V


def panel(spark, rows):
    return spark.createDataFrame(rows, "date string, t string, s string, f double, r double")


def ic_of(spark, pairs):
    rows = [("d", "1", f"s{i:02d}", f, r) for i, (f, r) in enumerate(pairs)]
    return E.cs_ic(panel(spark, rows), [("f", "r")], ["date", "t"], "s").first()


def test_ic_f17_f18(spark):
    assert abs(ic_of(spark, [(1.0, 1.0), (2.0, 2.0), (5.0, 5.0)]).ic - 1) < 1e-12
    assert ic_of(spark, [(1.0, 1.0), (1.0, 2.0)]).ic is None and ic_of(spark, [(1.0, 1.0)]).ic is None
    assert abs(ic_of(spark, [(1.0, 3.0), (2.0, 1.0)]).ic + 1) < 1e-12
    # ranks among all values of each: f has ranks 1..4 with one return missing, r has ranks 1..3
    pairs = [(10.0, 1.0), (20.0, None), (30.0, 3.0), (40.0, 2.0)]
    r = ic_of(spark, pairs)
    f, q = [1, 3, 4], [1, 3, 2]
    mf, mq = sum(f) / 3, sum(q) / 3
    want = sum((a - mf) * (b - mq) for a, b in zip(f, q)) / math.sqrt(sum((a - mf) ** 2 for a in f) * sum((b - mq) ** 2 for b in q))
    assert abs(r.rankic - want) < 1e-12
    rows = [("d", str(i), "s", a, b) for i, (a, b) in enumerate(pairs)]
    joint = E.ts_ic(panel(spark, rows), [("f", "r")], ["date", "s"], "t").first()
    assert abs(joint.ts_rankic - 0.5) < 1e-12 and joint.ts_rankic != pytest.approx(r.rankic)


def test_limit_rows_do_not_count_in_ts(spark):
    rows = [("d", str(i), "s", float(i), float(i * i), i == 3) for i in range(4)]
    df = spark.createDataFrame(rows, "date string, t string, s string, f double, r double, f_has_limit boolean")
    a = E.ts_ic(df, [("f", "r")], ["date", "s"], "t").first()
    b = E.ts_ic(df.filter("t <> '3'").drop("f_has_limit"), [("f", "r")], ["date", "s"], "t").first()
    assert a.ts_ic == b.ts_ic


def test_sessions_and_window_numbers(spark):
    df = spark.createDataFrame([("11:29:57",), ("11:30:00",), ("13:00:00",)], "t string")
    assert sorted((r.t, r.session) for r in E.with_session(df, "t", "11:29:57", "13:00:00").collect()) == [("11:29:57", "all"), ("11:29:57", "am"), ("11:30:00", "all"), ("13:00:00", "all"), ("13:00:00", "pm")]
    names = spark.createDataFrame([("acc_mom_25_50t", "acc_mom"), ("bap_15m", "bap"), ("bap_x", "bap")], "c string, n string")
    assert [r[0] for r in names.select(E.window_number(F.col("c"), F.col("n"))).collect()] == [25, 15, 0]


def test_stats_f22(spark):
    daily = spark.createDataFrame([(str(d), "c", v, v) for d, v in enumerate([0.1, 0.2, 0.15, 0.3])], "date string, factor_col string, ic double, rankic double")
    s = E.cs_stats(daily, ["factor_col"]).first()
    assert (round(s.ic_mean, 4), round(s.ic_std, 10), s.n_days) == (0.1875, 0.0853912564, 4) and abs(s.icir - s.ic_mean / s.ic_std) < 1e-12
    c = E.cs_stats(daily, ["factor_col"], compat=True).first()
    assert (round(c.ic_std, 10), c.n_days) == (0.0739509973, 5)  # D-03


@pytest.mark.parametrize("n, sizes", [(7, [2, 1, 2, 1, 1]), (8, [2, 2, 1, 2, 1]), (12, [3, 2, 3, 2, 2]), (13, [3, 3, 2, 3, 2]), (4, None)])
def test_buckets_f19_f20(spark, n, sizes):
    df = panel(spark, [("d", "1", f"s{i:02d}", float(i), float(i)) for i in range(n)] + [("d", "1", "zz", None, 1.0)])
    got = df.withColumn("b", Q.bucket_of("f", ["date", "t"], "s", 5)).groupBy("b").count().collect()
    counts = {r.b: r["count"] for r in got}
    assert counts == ({None: n + 1} if sizes is None else {**{k + 1: v for k, v in enumerate(sizes)}, None: 1})
    row = Q.bucket_returns(df, ["f"], "r", ["date", "t"], "s").first()
    assert row.n_valid == n and (row.g1 is None) == (sizes is None)


def test_ties_go_by_security_f27(spark):
    df = panel(spark, [("d", "1", s, 1.0, 0.0) for s in "cbade"])
    assert {r.s: r.b for r in df.withColumn("b", Q.bucket_of("f", ["date", "t"], "s", 5)).collect()} == dict(zip("abcde", range(1, 6)))


def test_curves_f21(spark):
    rows = [("f", d, str(t), *[None if v is None else float(v)] * 5) for d, vs in (("d1", [1, 2, None]), ("d2", [None, None, None]), ("d3", [4, None, 1])) for t, v in enumerate(vs)]
    b = spark.createDataFrame(rows, "factor_col string, date string, t string, " + ", ".join(f"g{k} double" for k in range(1, 6)))
    ticks, days = Q.cumulative_ticks(b, "date", "t"), Q.cumulative_days(b, "date")
    assert [r.g1 for r in ticks.filter("date = 'd1'").orderBy("t").collect()] == [1.0, 3.0, None]
    assert [(r.date, r.g1, r.n_ticks, r.long_short) for r in days.orderBy("date").collect()] == [("d1", 3.0, 2, 0.0), ("d2", None, 2, None), ("d3", 8.0, 4, 0.0)]  # D-04
    stitched = Q.stitched_ticks(ticks, days, "date", "t")
    assert [r.g1 for r in stitched.orderBy("date", "t").collect()] == [1.0, 3.0, None, None, None, None, 7.0, None, 8.0]
    chart = Q.chart_curve(stitched.withColumn("date", F.regexp_replace("date", "d", "2024-01-0")), "date", "t").orderBy("x").collect()
    assert [r.x for r in chart] == list(range(9)) and [r.month_start for r in chart] == [True] + [False] * 8
    assert V.day_pnl(ticks, "date", "t").orderBy("date").first().g1_per_tick == 1.5


def test_weights_scores_composites_f23_to_f25(spark):
    stats = spark.createDataFrame([("r", "all", "a", 0.03), ("r", "all", "b", -0.05), ("r", "all", "c", 0.01), ("r", "am", "c", 0.9)], "ret string, session string, factor_col string, ic_mean double")
    w = Q.collected_weights(Q.ic_weights(stats, 0.02))
    assert {k: round(v, 9) for k, v in w.items()} == {"a": 0.375, "b": -0.625}
    df = spark.createDataFrame([("d", f"s{i}", float(i), None if i == 3 else float(-i), 0.1) for i in range(4)], "date string, s string, a double, b double, ret double")
    assert sorted(r[0] for r in df.select(Q.percentile_score("a", ["date"], "s")).collect()) == [0, 0.25, 0.5, 0.75]
    got = {r.s: r.composite for r in Q.composite(df, w, ["date"], "s").collect()}
    assert abs(got["s3"] - 0.75) < 1e-12 and abs(got["s0"] - (0 - 0.625 * 2 / 3)) < 1e-12
    deciles = Q.composite_deciles(Q.composite(df, w, ["date"], "s"), "ret", ["date"], "s", 4).first()
    assert deciles.n_valid == 4 and deciles.g1 == 0.1


def test_views_f26(spark):
    days = spark.createDataFrame([("f", "d1", 9.0, 9.0, 9.0, 9.0, 9.0, 0.0, 5), ("f", "d2", 0.4, 0.3, 0.2, 0.1, 0.0, -0.4, 10)], "factor_col string, date string, g1 double, g2 double, g3 double, g4 double, g5 double, long_short double, n_ticks long")
    assert abs(V.monotonicity(days, "date").first().monotonicity - 2) < 1e-9
    p = V.pnl_stats(days, "date").first()
    assert p.total_ticks == 10 and abs(p.g1_per_tick - 0.04) < 1e-12
    meta = spark.createDataFrame([("bap", "Book pressure", None), ("mom", "Momentum", "price")], "a string, b string, c string")
    assert [r.a for r in V.search(meta, "PRESS|xyz").collect()] == ["bap"]
    names = spark.createDataFrame([("bap_15m",), ("bap_5m",), ("x",)], "n string")
    assert [r.n for r in names.orderBy(V.natural_order(F.col("n"))).collect()] == ["x", "bap_5m", "bap_15m"]


def test_returns_come_from_the_first_table_that_has_them(spark):
    from tickweave.operators.quantiles import with_returns

    one = spark.createDataFrame([("d1", "s", 0.1, 1.0)], "date string, security_id string, r double, f double")
    two = spark.createDataFrame([("d1", "s", 0.9, 2.0), ("d2", "s", 0.2, 3.0)], "date string, security_id string, r double, g double")
    three = spark.createDataFrame([("d3", "s", 0.3, 4.0), ("d2", "s", 0.8, 5.0)], "date string, security_id string, r double, h double")
    got = with_returns([one, two, three], ["date", "security_id"], ["r"])
    assert sorted(got.columns) == ["date", "f", "g", "h", "r", "security_id"]
    assert {x.date: (x.r, x.f, x.g, x.h) for x in got.collect()} == {"d1": (0.1, 1.0, 2.0, None), "d2": (0.2, None, 3.0, 5.0), "d3": (0.3, None, None, 4.0)}
