import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickweave.functions.exprs import div, flag, number, tidy
from tickweave.functions.windows import count_of, gate, masked_mean, rolling_sums, with_position


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,), (" 2 ",)], "s string")
    assert [r[0] for r in df.select(number(F.col("s"))).collect()] == [1.5, None, None, None, None, 2.0]
    r = spark.range(1).select(div(F.lit(1), F.lit(0)), flag(F.lit(None) > 1), tidy(F.lit(-1e-12)), tidy(F.lit(0.0078125))).first()
    assert r[0] is None and r[1] is False and str(r[2]) == "0.0" and r[3] == 0.007813


def test_rolling_sums_against_pandas(spark):
    rnd = random.Random(1)
    rows = [(s, i, rnd.choice([None, rnd.random()])) for s in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "s string, i int, v double")
    out = rolling_sums(with_position(df, ["s"], "i"), ["s"], "i", {"t": (F.col("v"), [3, 10]), "n": (count_of(F.col("v").isNotNull()), [3, 10])})
    got = out.select("*", *[masked_mean(F.col(f"t_{w}"), F.col(f"n_{w}")).alias(f"m_{w}") for w in (3, 10)]).toPandas().sort_values(["s", "i"])
    for s, g in got.groupby("s"):
        for w in (3, 10):
            want = pd.Series([v for k, _, v in rows if k == s], dtype=float).rolling(w, min_periods=1).mean()
            assert np.allclose(g[f"m_{w}"].to_numpy(float), want.to_numpy(), equal_nan=True)
        assert g["_pos"].tolist() == list(range(50))


def test_gate(spark):
    # F-11: of ten, one invalid passes and two do not; the first nine rows never pass
    df = spark.createDataFrame([(9, 9), (9, 8), (8, 9)], "pos int, valid int")
    assert [r[0] for r in df.select(gate(F.col("valid"), 10, F.col("pos"))).collect()] == [True, False, False]


def test_ladders():
    from tickweave.functions.windows import ladder, rungs_of

    assert ladder([300, 600, 2100]) == [1, 4, 12, 60, 300] and ladder([4, 6, 12]) == [1, 2] and ladder([1]) == [1] and ladder([2, 9]) == [1, 4]
    for windows in ([300, 900, 1500], [200, 400, 2100], [37], [7, 101, 1999], [4099], [20, 60]):
        lengths = ladder(windows)
        assert all(b % a == 0 and b // a <= 64 for a, b in zip(lengths, lengths[1:]))
        for w in windows:
            rungs = rungs_of(w, lengths)
            assert sum(n for n, _ in rungs) == w and [b for _, b in rungs] == [sum(n for n, _ in rungs[:k]) for k in range(len(rungs))] and len(rungs) <= 40


def test_local_sums_and_moments(spark):
    import numpy as np

    from tickweave.functions.windows import local_comoments, local_moments, local_sums

    r = np.random.default_rng(1)
    whole = 0
    rows = [("a" if i < 700 else "b", i, None if r.random() < 0.01 else float(r.normal()), None if r.random() < 0.1 else float(r.normal()) + 100) for i in range(900)]
    rows[50] = ("a", 50, 1e11, 1e9)  # what one value does ends with its window
    df = spark.createDataFrame(rows, "g string, t int, x double, y double")
    windows = [12, 60, 90]
    out = local_sums(df, ["g"], "t", {"s": (F.col("x"), windows), "u": (F.col("y"), [60])})
    out = local_moments(out, ["g"], "t", {"_m": (F.col("x"), windows), "_o": (F.col("y"), [12])}, cubes=True)
    out = local_comoments(out, ["g"], "t", "_b", F.col("x"), F.col("y"), windows)
    assert "u_60" in out.columns and "u_12" not in out.columns and "_o_12" in out.columns and "_o_60" not in out.columns
    for row in out.collect():
        own = [q for q in rows if q[0] == row.g and q[1] <= row.t]
        for w in windows:
            near = [q for q in own if q[1] > row.t - w]
            v = np.array([q[2] for q in near if q[2] is not None])
            b = np.array([q[2:] for q in near if None not in q]).reshape(-1, 2)
            scale = max(1.0, np.abs(v).max(initial=0))
            assert abs(row[f"s_{w}"] - v.sum()) <= 1e-12 * w * scale
            t = row[f"_b_{w}"]
            if len(b):
                d = b - b.mean(0)
                assert t.n == len(b) and abs(t.xy - (d[:, 0] * d[:, 1]).sum()) <= 1e-10 * w * scale * max(1.0, np.abs(b[:, 1]).max())
            m = row[f"_m_{w}"]
            if len(v) < w:
                assert m.x is None and m.xx is None and m.xxx is None
                continue
            whole += 1
            assert abs(m.x - v.mean()) <= 1e-12 * scale
            assert abs(m.xx - ((v - v.mean()) ** 2).sum()) <= 1e-11 * w * scale**2 and abs(m.xxx - ((v - v.mean()) ** 3).sum()) <= 1e-10 * w * scale**3
    assert whole > 900
