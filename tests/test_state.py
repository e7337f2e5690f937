"""States of days: merged in any cut they are what all days give."""

import random

import numpy as np
import pytest

from tickweave.operators import quantiles as Q
from tickweave.operators import state as S

KEYS = ["k", "f"]


def rows(seed=2):
    r = random.Random(seed)
    out = [(f"d{d}", k, f, None if r.random() < 0.2 else 1e6 + r.gauss(0, 1), r.random()) for d in range(9) for k in ("a", None) for f in "xy" if not (f == "y" and d < 4) for _ in range(2)]
    return [*out, ("d8", "late", "x", 1.0, 2.0), ("d0", "early", "x", None, None)]


@pytest.mark.parametrize("cut", ["d0", "d1", "d5", "d8", "d9"])
def test_merged(spark, cut):
    df = spark.createDataFrame(rows(), "date string, k string, f string, v double, w double")
    one, other = (S.state_of(df.filter(c), KEYS, ["v", "w"], "date") for c in (f"date < '{cut}'", f"date >= '{cut}'"))
    got = {(r.k, r.f): r for r in S.merged(one, other, KEYS, ["v", "w"]).collect()}
    assert len(got) == 6
    for (k, f), r in got.items():
        own = [q for q in rows() if q[1] == k and q[2] == f]
        assert r.n_rows == len(own) and r.n_days == len({q[0] for q in own})
        for at, name in ((3, "v"), (4, "w")):
            v = np.array([q[at] for q in own if q[at] is not None])
            assert r[f"n_{name}"] == len(v) and (len(v) == 0 or abs(r[f"mean_{name}"] - v.mean()) < 1e-9 * max(1, abs(v.mean())))
            assert abs(r[f"m2_{name}"] - ((v - v.mean()) ** 2).sum() if len(v) else 0) < 1e-6


def test_curves_go_on(spark):
    r = random.Random(3)
    value = lambda: None if r.random() < 0.3 else r.random()
    data = [("x" if k else "y", f"d{d}", f"{t}", *[None if d == 3 else value() for _ in range(5)]) for k in range(2) for d in range(6) for t in range(4)]
    b = spark.createDataFrame(data, "factor_col string, date string, t string, " + ", ".join(f"g{k} double" for k in range(1, 6)))
    want = {(x.factor_col, x.date): x for x in Q.cumulative_days(b, "date").collect()}
    curve = Q.cumulative_days(b.filter("date < 'd2'"), "date")
    for d in range(2, 6):
        curve = curve.unionByName(S.continued(S.totals_of(b.filter(f"date = 'd{d}'"), ["factor_col"], Q.groups(5), "g5", "date"), curve, ["factor_col"], Q.groups(5), "date"))
    got = curve.collect()
    assert len(got) == len(want) == 12
    for x in got:
        w = want[x.factor_col, x.date]
        assert x.n_ticks == w.n_ticks and all((x[c] is None) == (w[c] is None) and (w[c] is None or abs(x[c] - w[c]) < 1e-12) for c in [*Q.groups(5), "long_short"])
