import math
import random

import numpy as np
import pandas as pd
import pytest

from tickweave.operators.factors import FACTORS, factor_columns, factor_summary, register, run_factor
from tickweave.sources.schemas import BOOK

BY, ORDER = ("date", "security_id"), "tick_idx"


def make(n=160, seed=3, gaps=0.04, flat=False):
    rnd = random.Random(seed)
    rows, price, volume = [], 10.0, 0.0
    for i in range(n):
        price *= 1 if flat else 1 + rnd.gauss(0, 0.002)
        volume += rnd.randint(0, 30)
        usable = rnd.random() > gaps
        double = usable and rnd.random() > 0.03
        five = double and rnd.random() > 0.02
        book = {f"{s}{w}{k}": price + (1 if s == "Ask" else -1) * 0.01 * (k + rnd.random() * 0.4) if w == "Price" else float(rnd.randint(1, 99)) for s in ("Ask", "Bid") for w in ("Price", "Volume") for k in range(1, 6)}
        rows.append({"date": "d", "security_id": "s", "tick_idx": i, "Price": price if usable else None, "CanUsePrice": usable, "CanUseDoubleSideBook": double, "CanUseFiveLevelBook": five, "CumVolume": volume, **book})
    return pd.DataFrame(rows)


def run(spark, pdf, name, windows, **options):
    kinds = {"date": "string", "security_id": "string", "tick_idx": "int"} | {c: "boolean" for c in pdf if c.startswith("CanUse")}
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf))
    return run_factor(df, name, BY, ORDER, windows, **options).toPandas().sort_values("tick_idx").reset_index(drop=True)


def ok(mask, w, t):
    return t >= w - 1 and 10 * (w - mask[t - w + 1 : t + 1].sum()) <= w


def check(got, want, tolerance=1e-9):
    for t, (g, x) in enumerate(zip(got, want)):
        assert (pd.isna(g)) == (x is None), (t, g, x)
        if x is not None:
            assert abs(g - x) <= tolerance * max(1, abs(x)), (t, g, x)


def test_mean_factors(spark):
    p = make()
    bv = lambda i: p[f"BidVolume{i}"]
    av = lambda i: p[f"AskVolume{i}"]
    weights = [1, 0.8, 0.6, 0.4, 0.2]
    spread = lambda s, sign: sign * (p[f"{s}Price1"] - p[f"{s}Price5"]) / 4
    raws = {
        "bap": ((bv(1) - av(1)) / (bv(1) + av(1))).where(p.CanUseDoubleSideBook),
        "oir": (sum(w * (bv(i) - av(i)) for i, w in enumerate(weights, 1)) / sum(w * (bv(i) + av(i)) for i, w in enumerate(weights, 1))).where(p.CanUseFiveLevelBook),
        "ofd": ((sum(bv(i) for i in range(1, 6)) / spread("Bid", 1)) / (sum(av(i) for i in range(1, 6)) / spread("Ask", -1))).where(p.CanUseFiveLevelBook),
    }
    limit = p.CanUsePrice & ~p.CanUseDoubleSideBook
    for name, raw in raws.items():
        got = run(spark, p, name, {"20t": 20})
        gates = [ok(raw.notna().to_numpy(), 20, t) for t in range(len(p))]
        check(got[f"{name}_20t"], [raw[t - 19 : t + 1].mean() if gates[t] else None for t in range(len(p))])
        assert got[f"{name}_20t_has_limit"].tolist() == [bool(gates[t] and limit[t - 19 : t + 1].any()) for t in range(len(p))]  # D-07


def test_momentum(spark):
    p = make()
    ln = np.log(p.Price.astype(float))
    got = run(spark, p, "mom", {"7t": 7})
    check(got["mom_7t"], [None if t < 7 or pd.isna(ln[t]) or pd.isna(ln[t - 7]) else ln[t] - ln[t - 7] for t in range(len(p))])
    got = run(spark, p, "acc_mom", {"3_9t": (3, 9)})
    want = [None if t < 9 or any(pd.isna(ln[t - k]) for k in (0, 3, 9)) else ln[t] - 2 * ln[t - 3] + ln[t - 9] for t in range(len(p))]
    check(got["acc_mom_3_9t"], want)
    limit = p.CanUsePrice & ~p.CanUseDoubleSideBook
    assert got["acc_mom_3_9t_has_limit"].tolist() == [bool(want[t] is not None and (limit[t] or limit[t - 3] or limit[t - 9])) for t in range(len(p))]


def test_amp_slice(spark):
    p = make()
    v = p.Price.astype(float)
    want = []
    for t in range(len(p)):
        if not ok(p.CanUsePrice.to_numpy(), 60, t):
            want.append(None)
            continue
        cells = [v[t - 59 + 10 * g : t - 49 + 10 * g] for g in range(6)]
        if any(c.isna().all() or c.min() <= 0 for c in cells):
            want.append(None)
            continue
        order = sorted(range(6), key=lambda g: (cells[g].mean(), g))
        amp = [c.max() / c.min() - 1 for c in cells]
        want.append(amp[order[-1]] - amp[order[0]])
    check(run(spark, p, "amp_slice", {"60t": 60})["amp_slice_60t"], want)


def test_rigidity_and_f16(spark):
    p = make()
    v = p.Price.astype(float)
    want = []
    for t in range(len(p)):
        if not ok(p.CanUsePrice.to_numpy(), 40, t):
            want.append(None)
            continue
        y = v[t - 39 : t + 1].to_numpy()
        x = np.arange(40)[~np.isnan(y)]
        y = y[~np.isnan(y)]
        c, b, a = np.polyfit(x, y, 2)
        r2 = 1 - ((y - a - b * x - c * x * x) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        want.append(b * r2 * math.log(1 / (abs(c) + 1e-8)))
    check(run(spark, p, "rigidity", {"2m": 40})["rigidity_2m"], want, 1e-5)
    curve = make(60, gaps=0.05)
    curve["Price"] = [5 + 0.3 * i + 0.01 * i * i if u else None for i, u in enumerate(curve.CanUsePrice)]
    got = run(spark, curve, "rigidity", {"1m": 20})
    t = 45
    b, c = 0.3 + 2 * 0.01 * (t - 19), 0.01
    if ok(curve.CanUsePrice.to_numpy(), 20, t):
        assert abs(got["rigidity_1m"][t] - b * math.log(1 / (c + 1e-8))) < 1e-4  # D-09: x keeps its gaps
    assert run(spark, make(60, flat=True, gaps=0), "rigidity", {"1m": 20})["rigidity_1m"].isna().all()  # F-15


def test_neg_skew_and_f13_f15(spark):
    p = make(gaps=0.0)
    p.loc[70, ["Price", "CanUsePrice"]] = [None, False]
    r = p.Price.astype(float) / p.Price.astype(float).shift(5) - 1
    want = [None if t < 44 or r[t - 39 : t + 1].isna().any() else -r[t - 39 : t + 1].skew() for t in range(len(p))]
    got = run(spark, p, "neg_skew", {"2m": 40}, lag=5)["neg_skew_2m"]
    check(got, want, 1e-7)
    assert got[70:110].isna().all()  # D-06
    flat = run(spark, make(80, flat=True, gaps=0), "neg_skew", {"1m": 20}, lag=2)["neg_skew_1m"]
    assert flat[21:].tolist() == [0.0] * 59


def test_pv_corr(spark):
    p = make(gaps=0.01)
    w = 8
    price, volume = p.Price.astype(float), p.CumVolume.where(p.CanUsePrice)
    rp, rv = price / price.shift(w) - 1, volume / volume.shift(w).where(volume.shift(w) > 1e-12) - 1
    z = lambda r, t: None if t < 2 * w - 1 or r[t - 2 * w + 1 : t + 1].isna().any() or r[t - 2 * w + 1 : t + 1].std(ddof=0) == 0 else (r[t] - r[t - 2 * w + 1 : t + 1].mean()) / r[t - 2 * w + 1 : t + 1].std(ddof=0)
    raw = pd.Series([None if z(rp, t) is None or z(rv, t) is None or not p.CanUsePrice[t] else z(rp, t) * np.sign(z(rv, t)) for t in range(len(p))], dtype=float)
    want = []
    for t in range(len(p)):
        m = raw[max(0, t - w + 1) : t + 1].mean()
        want.append(m if ok(p.CanUsePrice.to_numpy(), 4 * w, t) and not pd.isna(m) else None)
    check(run(spark, p, "pv_corr", {"8t": w})["pv_corr_8t"], want, 1e-7)


def test_rsrs_and_constant_books(spark):
    p = make()
    side = lambda s: (sum(p[f"{s}Price{i}"] * p[f"{s}Volume{i}"] for i in range(1, 6)) / sum(p[f"{s}Volume{i}"] for i in range(1, 6))).where(p.CanUseFiveLevelBook)
    x, y = side("Bid"), side("Ask")
    want = []
    for t in range(len(p)):
        a, b = x[max(0, t - 19) : t + 1].dropna(), y[max(0, t - 19) : t + 1].dropna()
        want.append(np.polyfit(a - a.iloc[0], b, 1)[0] if ok(p.CanUseFiveLevelBook.to_numpy(), 20, t) else None)
    check(run(spark, p, "rsrs", {"1m": 20})["rsrs_1m"], want, 1e-6)
    for c in BOOK:
        p[c] = p[c][0]
    assert run(spark, p, "rsrs", {"1m": 20})["rsrs_1m"].isna().all()  # D-19


def test_registry_and_summary(spark):
    assert sum(len(s.windows) for s in FACTORS.values()) == 55
    assert FACTORS["mom"].windows["90m"] == 1800 and FACTORS["acc_mom"].windows["25_50t"] == (25, 50)
    p = make(30)
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), ", ".join(f"{c} {'boolean' if c.startswith('CanUse') else 'string' if c in BY else 'int' if c == ORDER else 'double'}" for c in p))
    register("twice", lambda d, windows, by, order: d.withColumns({"twice_1t": d.Price * 2, "twice_1t_has_limit": d.CanUsePrice}), {"1t": 1})
    out = run_factor(df, "twice")
    assert factor_columns(out, "twice") == ["twice_1t"]
    assert factor_summary(out, "twice").first().nnz_twice_1t == p.Price.notna().sum()
    del FACTORS["twice"]
    with pytest.raises(KeyError):
        run_factor(df, "none")


@pytest.mark.parametrize("n, w", [(12_000, 40), (9_200, 4_500)])
def test_rigidity_in_long_partitions_and_windows(spark, n, w):
    p = make(n, gaps=0.02)
    got = run(spark, p, "rigidity", {"w": w})["rigidity_w"]
    for t in (w - 1, w, 2 * w - 1, 2 * w, n - 2, n - 1):
        y = p.Price.astype(float)[t - w + 1 : t + 1].to_numpy()
        x = np.arange(w)[~np.isnan(y)]
        y = y[~np.isnan(y)]
        if 10 * (w - len(y)) > w:
            assert pd.isna(got[t])
            continue
        c, b, a = np.polyfit(x, y, 2)
        r2 = 1 - ((y - a - b * x - c * x * x) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        want = b * r2 * math.log(1 / (abs(c) + 1e-8))
        assert abs(got[t] - want) < 1e-5 * max(1.0, abs(want))


@pytest.mark.parametrize("name, windows, options", [("bap", {"20t": 20}, {}), ("ofd", {"20t": 20}, {}), ("rigidity", {"20t": 20, "60t": 60}, {}), ("neg_skew", {"20t": 20}, {"lag": 1}), ("pv_corr", {"5t": 5}, {}), ("rsrs", {"30t": 30}, {})])
def test_one_huge_value_spoils_no_later_window(spark, name, windows, options):
    """Windows that don't hold the value are what they are without it."""
    p = make(220, gaps=0.01)
    huge = p.copy()
    for c in ["Price", *[f"{s}Price{k}" for s in ("Ask", "Bid") for k in range(1, 6)]]:
        huge.loc[30, c] = p[c][30] * 1e11
    huge.loc[30, [f"BidVolume{k}" for k in range(1, 6)]] *= 1e9
    for q in (p, huge):
        q.loc[30, ["CanUsePrice", "CanUseDoubleSideBook", "CanUseFiveLevelBook"]] = True
    p.loc[30, "Price"] = huge.loc[30, "Price"] / 1e11 if pd.notna(huge.loc[30, "Price"]) else 10.0
    huge.loc[30, "Price"] = p.loc[30, "Price"] * 1e11
    one, other = run(spark, p, name, windows, **options), run(spark, huge, name, windows, **options)
    for label in windows:
        a, b = one[f"{name}_{label}"][140:], other[f"{name}_{label}"][140:]
        assert a.notna().any() and a.isna().tolist() == b.isna().tolist() and np.allclose(a.dropna().astype(float), b.dropna().astype(float), rtol=1e-9, atol=1e-12)
