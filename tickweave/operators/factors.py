"""The factor library (OP-44 to OP-54) and its registry.

A factor adds, for each of its windows, a value column and a `_has_limit` column (whether a limit tick is among the ticks used).
Windows are made without moving frames (functions.along): Spark deals and sorts the rows, numpy steps over them in batches; sums and moments are put together from the window's own rows,
and everything before and after is plain columns. So a factor costs one exchange and one sort, which factors that run one after the other share if the rows are dealt before (`along.dealt`).
Where `_pos`, the places in the group, is given, long groups are cut into stretches.

Input: base ticks (operators.base) - Price, CanUsePrice, CanUseDoubleSideBook, CanUseFiveLevelBook and what the factor names in `needs`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.config import TICKS_PER_MINUTE
from tickweave.functions.exprs import add_up, div, flag
from tickweave.functions.along import Parts, Rows, State, along, dealt, stretch_rows
from tickweave.functions.windows import gate, masked_mean
from tickweave.operators.base import ask, ask_volume, bid, bid_volume, limit_tick
from tickweave.sources.schemas import LEVELS

TINY = 1e-12
By = tuple[str, ...]
Windows = dict[str, int]  # label -> ticks


def minutes(*values: int) -> Windows:
    return {f"{v}m": v * TICKS_PER_MINUTE for v in values}


def ticks(*values: int) -> Windows:
    return {f"{v}t": v for v in values}


def _along(df: DataFrame, by: By, order: str, back: int, columns: dict[str, Column], out: list[str], f: Callable[[Rows, State], dict], tasks: int | None = None, placed: bool = False, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows with what f makes of `columns` and `_limit`, names of the columns they came with). keep: the columns wanted of df beside by and order; nothing else goes through the exchange."""
    own = [c for c in (*by, order, "_pos", "_part") if c in df.columns]
    before = df.columns if keep is None else list(dict.fromkeys([*own, *keep]))
    inputs = {"_limit": flag(limit_tick()), **columns}
    ready = dealt(df.withColumns(inputs).select(*before, *inputs), by, order, back, tasks, placed)
    found = along(ready, by, list(inputs), ", ".join(out), f, back)
    cut = "_pos" in df.columns and "_part" not in df.columns
    return stretch_rows(found, back) if cut else found, before


def _done(df: DataFrame, before: list[str], out: dict[str, Column]) -> DataFrame:
    return df.withColumns(out).select(*before, *out)


def _fields(kind: str, *names: str) -> list[str]:
    return [f"{name} {kind}" for name in names]


# ---- means of a raw value (OP-44, OP-52, OP-53)


def mean_factors(df: DataFrame, raws: dict[str, Column], windows: Windows, by: By, order: str, **deal) -> DataFrame:
    """Means of several raw values in one pass; what they are made of goes no further than that."""
    names, ws = list(raws), list(dict.fromkeys(windows.values()))

    def f(rows: Rows, v: State) -> dict:
        found = {f"_l_{w}": rows.count(v["_limit"], w) for w in ws}
        for name in names:
            raw = v[f"_raw_{name}"]
            sums = rows.sums(raw, ws)
            found |= {f"_{k}_{name}_{w}": x for w in ws for k, x in (("n", rows.count(~np.isnan(raw), w)), ("s", sums[w]))}
        return found

    out = _fields("long", *[f"_l_{w}" for w in ws]) + [x for n in raws for w in ws for x in (f"_n_{n}_{w} long", f"_s_{n}_{w} double")]
    df, before = _along(df, by, order, max(ws, default=1), {f"_raw_{name}": raw for name, raw in raws.items()}, out, f, **deal)
    out = {}
    for name in raws:
        for label, w in windows.items():
            ok = gate(F.col(f"_n_{name}_{w}"), w, F.col("_pos"))
            out[f"{name}_{label}"] = F.when(ok, masked_mean(F.col(f"_s_{name}_{w}"), F.col(f"_n_{name}_{w}")))
            out[f"{name}_{label}_has_limit"] = flag(ok & (F.col(f"_l_{w}") > 0))
    return _done(df, before, out)


def bap_raw() -> Column:
    """OP-44: pressure of the first level's volumes, averaged."""
    total = bid_volume(1) + ask_volume(1)
    raw = F.when(F.col("CanUseDoubleSideBook") & (total > TINY), div(bid_volume(1) - ask_volume(1), total))
    return raw


def bap(df: DataFrame, windows: Windows, by: By, order: str, **deal) -> DataFrame:
    return mean_factors(df, {"bap": bap_raw()}, windows, by, order, **deal)


OIR_WEIGHTS = (1.0, 0.8, 0.6, 0.4, 0.2)  # fixed values, by level


def oir_raw() -> Column:
    """OP-52: weighted imbalance over five levels, averaged."""
    over = add_up(*[F.lit(w) * (bid_volume(i) - ask_volume(i)) for i, w in zip(LEVELS, OIR_WEIGHTS)])
    under = add_up(*[F.lit(w) * (bid_volume(i) + ask_volume(i)) for i, w in zip(LEVELS, OIR_WEIGHTS)])
    raw = F.when(F.col("CanUseFiveLevelBook") & (under > TINY), div(over, under))
    return raw


def oir(df: DataFrame, windows: Windows, by: By, order: str, **deal) -> DataFrame:
    return mean_factors(df, {"oir": oir_raw()}, windows, by, order, **deal)


def ofd_raw() -> Column:
    """OP-53: ratio of the sides' depth per average price step, averaged."""

    def density(price: Callable[[int], Column], volume: Callable[[int], Column], sign: int) -> Column:
        spread = add_up(*[sign * (price(i) - price(i + 1)) for i in LEVELS[:-1]]) / 4
        return F.when(spread > TINY, div(add_up(*[volume(i) for i in LEVELS]), spread))

    asks = density(ask, ask_volume, -1)
    raw = F.when(F.col("CanUseFiveLevelBook") & (asks > TINY), div(density(bid, bid_volume, 1), asks))
    return raw


def ofd(df: DataFrame, windows: Windows, by: By, order: str, **deal) -> DataFrame:
    return mean_factors(df, {"ofd": ofd_raw()}, windows, by, order, **deal)


# ---- momentum (OP-45, OP-46)


def _ln_price() -> Column:
    return F.when(F.col("CanUsePrice"), F.ln("Price"))


def mom(df: DataFrame, windows: Windows, by: By, order: str, **deal) -> DataFrame:
    """OP-45: log price change over w rows."""
    ws = list(dict.fromkeys(windows.values()))

    def f(rows: Rows, v: State) -> dict:
        ln, limit = v["_ln"], v["_limit"]
        return {f"_d_{w}": ln - rows.lag(ln, w) for w in ws} | {f"_l_{w}": limit | rows.lag(limit, w, False) for w in ws}

    out = _fields("double", *[f"_d_{w}" for w in ws]) + _fields("boolean", *[f"_l_{w}" for w in ws])
    df, before = _along(df, by, order, max(ws, default=1), {"_ln": _ln_price()}, out, f, **deal)
    out = {}
    for label, w in windows.items():
        out[f"mom_{label}"] = F.col(f"_d_{w}")
        out[f"mom_{label}_has_limit"] = F.col(f"_d_{w}").isNotNull() & F.col(f"_l_{w}")
    return _done(df, before, out)


def acc_mom(df: DataFrame, windows: dict[str, tuple[int, int]], by: By, order: str, **deal) -> DataFrame:
    """OP-46: the last short stretch's log change less that of the stretch before it; windows are (short, long)."""
    pairs = list(dict.fromkeys(windows.values()))

    def f(rows: Rows, v: State) -> dict:
        ln, limit, found = v["_ln"], v["_limit"], {}
        for short, long in pairs:
            near, far = rows.lag(ln, short), rows.lag(ln, long)
            found[f"_d_{short}_{long}"] = (ln - near) - (near - far)
            found[f"_l_{short}_{long}"] = limit | rows.lag(limit, short, False) | rows.lag(limit, long, False)
        return found

    out = _fields("double", *[f"_d_{s}_{n}" for s, n in pairs]) + _fields("boolean", *[f"_l_{s}_{n}" for s, n in pairs])
    df, before = _along(df, by, order, max((max(p) for p in pairs), default=1), {"_ln": _ln_price()}, out, f, **deal)
    out = {}
    for label, (short, long) in windows.items():
        value = F.col(f"_d_{short}_{long}")
        out[f"acc_mom_{label}"] = value
        out[f"acc_mom_{label}_has_limit"] = value.isNotNull() & F.col(f"_l_{short}_{long}")
    return _done(df, before, out)


# ---- amplitude by price level (OP-47)


def amp_slice(df: DataFrame, windows: Windows, by: By, order: str, group: int = 10, **deal) -> DataFrame:
    """OP-47: mean amplitude of the dearest fifth of the window's groups less that of the cheapest fifth.

    The groups of a window are the `group`-row frames that end at its last row and every `group` rows before: work in proportion to groups, not to ticks. Of equal levels the
    earlier group is the cheaper.
    """
    ws = list(dict.fromkeys(windows.values()))

    def f(rows: Rows, v: State) -> dict:
        frame = np.stack([rows.lag(v["_p"], k) for k in reversed(range(group))])
        there = ~np.isnan(frame)
        # from the first to the last of a frame, so that frames of the same prices have the same level
        level = np.add.accumulate(np.where(there, frame, 0.0))[-1] / there.sum(axis=0)
        low, high = np.fmin.reduce(frame), np.fmax.reduce(frame)
        level = np.where(low > 0, level, np.nan)
        amp = np.where(low > 0, high / low - 1, np.nan)
        found = {}
        for w in ws:
            n = w // group
            k = max(1, n // 5)
            there, full = rows.count(v["_use"], w), (rows.pos >= w - 1) & (rows.at >= (n - 1) * group)
            ok = np.flatnonzero(full & (10 * (w - there) <= w)) if n else rows.at[:0]
            value = np.full(len(level), np.nan)
            for some in np.array_split(ok, len(ok) * n // 4_000_000 + 1):
                cells = some[:, None] - group * np.arange(n - 1, -1, -1)
                by_level = np.take_along_axis(amp[cells], np.argsort(level[cells], axis=1, kind="stable"), axis=1)
                whole = ~np.isnan(level[cells]).any(axis=1)
                value[some] = np.where(whole, by_level[:, n - k :].sum(axis=1) / k - by_level[:, :k].sum(axis=1) / k, np.nan)
            found |= {f"_n_{w}": there, f"_l_{w}": rows.count(v["_limit"], w), f"_v_{w}": value}
        return found

    columns = {"_p": F.when(F.col("CanUsePrice"), F.col("Price")), "_use": flag(F.col("CanUsePrice"))}
    out = [x for w in ws for x in (*_fields("long", f"_n_{w}", f"_l_{w}"), f"_v_{w} double")]
    df, before = _along(df, by, order, max(ws, default=1) + group, columns, out, f, **deal)
    out = {}
    for label, w in windows.items():
        ok = gate(F.col(f"_n_{w}"), w, F.col("_pos"))
        out[f"amp_slice_{label}"] = F.when(ok, F.col(f"_v_{w}"))
        out[f"amp_slice_{label}_has_limit"] = flag(ok & (F.col(f"_l_{w}") > 0))
    return _done(df, before, out)


# ---- shape of the price path (OP-48)


def _powers(parts: Parts) -> State:
    """Merge stretches of rows: a (a price near, that others are taken less of), x0..x4 (sums of the valid rows' places, counted back from the end, to these powers), z0..z2 (those times
    the price less a) and zz (its square). A stretch that ends some rows back has its places moved by so many, and its prices taken less the common a."""
    near = parts[0][0]["a"]
    for p, *_ in parts[1:]:
        near = np.where(np.isnan(near), p["a"], near)
    by = [np.nan_to_num(near - p["a"]) for p, *_ in parts]
    moved = lambda of, back, k: sum(comb(k, i) * back ** (k - i) * of(i) for i in range(k + 1) if back or i == k)
    out = {"a": near} | {f"x{k}": sum(moved(lambda i: p[f"x{i}"], back, k) for p, back, _ in parts) for k in range(5)}  # noqa: B023
    for k in range(3):
        out[f"z{k}"] = sum(moved(lambda i: p[f"z{i}"] - d * p[f"x{i}"].astype(float), back, k) for d, (p, back, _) in zip(by, parts))  # noqa: B023
    out["zz"] = sum(p["zz"] - 2 * d * p["z0"] + d * d * p["x0"].astype(float) for d, (p, *_) in zip(by, parts))
    return out


def rigidity(df: DataFrame, windows: Windows, by: By, order: str, **deal) -> DataFrame:
    """OP-48: b R^2 ln(1 / (|c| + 1e-8)) of the fit P = a + b x + c x^2 over the valid ticks, x the row in the window.

    Powers of places are whole numbers and exact: longs for windows of up to 4,000 rows, whole numbers of Python beyond. Prices are taken less one of the window's own, so no row before the window has
    a part in it.
    """
    ws = list(dict.fromkeys(windows.values()))
    exact = max(ws, default=0) <= 4000
    xs, zs = [f"x{k}" for k in range(5)], ["z0", "z1", "z2", "zz"]

    def f(rows: Rows, v: State) -> dict:
        there, nothing = ~np.isnan(v["_p"]), np.zeros(len(rows.at))
        none = nothing.astype(np.int64 if exact else object)
        one = {"a": v["_p"], "x0": there.astype(np.int64).astype(none.dtype), **dict.fromkeys(xs[1:], none), **dict.fromkeys(zs, nothing)}
        found = rows.states(one, ws, _powers, {"a": np.nan, **dict.fromkeys(xs, 0), **dict.fromkeys(zs, 0.0)})
        out = {}
        for w in ws:
            t, s = [found[w][k] for k in xs], w - 1
            # powers of x = s - j, j counted back from the last row; exact until they are floats
            n, x1, x2 = t[0], s * t[0] - t[1], s**2 * t[0] - 2 * s * t[1] + t[2]
            x3 = s**3 * t[0] - 3 * s**2 * t[1] + 3 * s * t[2] - t[3]
            x4 = s**4 * t[0] - 4 * s**3 * t[1] + 6 * s**2 * t[2] - 4 * s * t[3] + t[4]
            n, x1, x2, x3, x4 = (x.astype(float) for x in (n, x1, x2, x3, x4))
            z0, z1, z2, zz = (found[w][k] for k in zs)
            y0, y1, y2 = z0, s * z0 - z1, s * s * z0 - 2 * s * z1 + z2
            # 2 x 2 minors of the normal equations
            a, b, c = x2 * x4 - x3 * x3, x1 * x4 - x2 * x3, x1 * x3 - x2 * x2
            d, e, g = n * x4 - x2 * x2, n * x3 - x1 * x2, n * x2 - x1 * x1
            det = n * a - x1 * b + x2 * c
            fa, fb, fc = (y0 * a - y1 * b + y2 * c) / det, (y1 * d - y0 * b - y2 * e) / det, (y0 * c - y1 * e + y2 * g) / det
            total, left = zz - y0 * y0 / n, zz - fa * y0 - fb * y1 - fc * y2
            fits = (n >= 3) & (det > 1e-20) & (total >= TINY)
            out |= {f"_n_{w}": rows.count(v["_use"], w), f"_l_{w}": rows.count(v["_limit"], w)}
            out[f"_v_{w}"] = np.where(fits, fb * (1 - left / total) * np.log(1 / (np.abs(fc) + 1e-8)), np.nan)
        return out

    columns = {"_p": F.when(F.col("CanUsePrice"), F.col("Price")), "_use": flag(F.col("CanUsePrice"))}
    out = [x for w in ws for x in (*_fields("long", f"_n_{w}", f"_l_{w}"), f"_v_{w} double")]
    df, before = _along(df, by, order, max(ws, default=1), columns, out, f, **deal)
    out = {}
    for label, w in windows.items():
        ok = gate(F.col(f"_n_{w}"), w, F.col("_pos"))
        out[f"rigidity_{label}"] = F.when(ok, F.col(f"_v_{w}"))
        out[f"rigidity_{label}_has_limit"] = flag(ok & (F.col(f"_l_{w}") > 0))
    return _done(df, before, out)


# ---- moments of returns (OP-49, OP-50)


def _change(rows: Rows, x: np.ndarray, usable: np.ndarray, lag: int, floor: float | None = None) -> np.ndarray:
    """x / x lag rows ago - 1, where both are usable and the earlier one is not 0 (or above the floor)."""
    earlier = rows.lag(x, lag)
    both = usable & rows.lag(usable, lag, False)
    return np.where(both & (earlier != 0 if floor is None else earlier > floor), x / earlier - 1, np.nan)


def neg_skew(df: DataFrame, windows: Windows, by: By, order: str, lag: int = TICKS_PER_MINUTE, **deal) -> DataFrame:
    """OP-49: minus the bias-corrected skew of the lag-row returns over w rows, none of them missing."""
    ws = list(dict.fromkeys(windows.values()))

    def f(rows: Rows, v: State) -> dict:
        r = _change(rows, v["_price"], v["_use"], lag)
        moments, found = rows.moments(r, ws), {}
        for w in ws:
            found |= {f"_k_{w}": rows.count(~np.isnan(r), w), f"_n_{w}": rows.count(v["_use"], w + lag), f"_l_{w}": rows.count(v["_limit"], w + lag)}
            found |= {f"_flat_{w}": rows.constant(r, w), f"_xx_{w}": moments[w]["xx"], f"_xxx_{w}": moments[w]["xxx"]}
        return found

    out = [x for w in ws for x in (*_fields("long", f"_k_{w}", f"_n_{w}", f"_l_{w}"), f"_flat_{w} boolean", *_fields("double", f"_xx_{w}", f"_xxx_{w}"))]
    columns = {"_price": F.col("Price"), "_use": flag(F.col("CanUsePrice"))}
    df, before = _along(df, by, order, max(ws, default=1) + lag, columns, out, f, **deal)
    out = {}
    for label, w in windows.items():
        ok = gate(F.col(f"_n_{w}"), w + lag, F.col("_pos"))
        m2, m3 = F.col(f"_xx_{w}") / w, F.col(f"_xxx_{w}") / w
        skew = F.lit((w * (w - 1)) ** 0.5 / (w - 2)) * div(m3, m2 * F.sqrt(m2))
        value = F.when(F.col(f"_flat_{w}"), F.lit(0.0)).when(m2 * w / (w - 1) > 1e-14, -skew)
        out[f"neg_skew_{label}"] = F.when(ok & (F.col(f"_k_{w}") == w), value)
        out[f"neg_skew_{label}_has_limit"] = flag(ok & (F.col(f"_l_{w}") > 0))
    return _done(df, before, out)


def pv_corr(df: DataFrame, windows: Windows, by: By, order: str, volume: str = "CumVolume", **deal) -> DataFrame:
    """OP-50: z-score of the price change times the sign of the volume change's, averaged over the usable rows of the last w."""
    ws = list(dict.fromkeys(windows.values()))

    def f(rows: Rows, v: State) -> dict:
        found = {}
        for w in ws:
            z = {}
            for k in "pv":
                x = _change(rows, v[f"_{k}"], v["_use"], w, TINY)
                m = rows.moments(x, [2 * w])[2 * w]
                spread = m["xx"] / (2 * w)
                moves = (rows.count(~np.isnan(x), 2 * w) == 2 * w) & ~rows.constant(x, 2 * w)
                z[k] = np.where(moves & (spread > 0), (x - m["x"]) / np.sqrt(np.maximum(spread, 0.0)), np.nan)
            raw = np.where(v["_use"], z["p"] * np.sign(z["v"]), np.nan)
            found |= {f"_n_{w}": rows.count(v["_use"], 4 * w), f"_l_{w}": rows.count(v["_limit"], 4 * w)}
            found |= {f"_rn_{w}": rows.count(~np.isnan(raw), w), f"_rs_{w}": rows.sums(raw, [w])[w]}
        return found

    out = [x for w in ws for x in (*_fields("long", f"_n_{w}", f"_l_{w}", f"_rn_{w}"), f"_rs_{w} double")]
    columns = {"_p": F.col("Price"), "_v": F.col(volume), "_use": flag(F.col("CanUsePrice"))}
    df, before = _along(df, by, order, 4 * max(ws, default=1), columns, out, f, **deal)
    out = {}
    for label, w in windows.items():
        ok = gate(F.col(f"_n_{w}"), 4 * w, F.col("_pos"))
        out[f"pv_corr_{label}"] = F.when(ok, masked_mean(F.col(f"_rs_{w}"), F.col(f"_rn_{w}")))
        out[f"pv_corr_{label}_has_limit"] = flag(ok & (F.col(f"_l_{w}") > 0))
    return _done(df, before, out)


# ---- book regression (OP-51)


def rsrs(df: DataFrame, windows: Windows, by: By, order: str, **deal) -> DataFrame:
    """OP-51: slope of the asks' volume-weighted price on the bids' over the five-level rows of the window."""
    ws = list(dict.fromkeys(windows.values()))

    def weighted(price: Callable[[int], Column], volume: Callable[[int], Column]) -> Column:
        total = add_up(*[F.coalesce(volume(i), F.lit(0.0)) for i in LEVELS])
        return F.when(total > TINY, div(add_up(*[F.coalesce(price(i) * volume(i), F.lit(0.0)) for i in LEVELS]), total))

    def f(rows: Rows, v: State) -> dict:
        both = v["_five"] & ~np.isnan(v["_bx"]) & ~np.isnan(v["_by"])
        x, y = (np.where(both, v[c], np.nan) for c in ("_bx", "_by"))
        moments, found = rows.comoments(x, y, ws), {}
        for w in ws:
            found |= {f"_k_{w}": rows.count(both, w), f"_n_{w}": rows.count(v["_five"], w), f"_l_{w}": rows.count(v["_limit"], w)}
            found |= {f"_varies_{w}": rows.varies(x, w), f"_xx_{w}": moments[w]["xx"], f"_xy_{w}": moments[w]["xy"]}
        return found

    out = [x for w in ws for x in (*_fields("long", f"_k_{w}", f"_n_{w}", f"_l_{w}"), f"_varies_{w} boolean", *_fields("double", f"_xx_{w}", f"_xy_{w}"))]
    columns = {"_bx": weighted(bid, bid_volume), "_by": weighted(ask, ask_volume), "_five": flag(F.col("CanUseFiveLevelBook"))}
    df, before = _along(df, by, order, max(ws, default=1), columns, out, f, **deal)
    out = {}
    for label, w in windows.items():
        n = F.col(f"_k_{w}")
        under, over = n * F.col(f"_xx_{w}"), n * F.col(f"_xy_{w}")
        ok = gate(F.col(f"_n_{w}"), w, F.col("_pos"))
        out[f"rsrs_{label}"] = F.when(ok & (n >= 2) & F.col(f"_varies_{w}") & (F.abs(under) > TINY), div(over, under))
        out[f"rsrs_{label}_has_limit"] = flag(ok & (F.col(f"_l_{w}") > 0))
    return _done(df, before, out)


# ---- registry (OP-54)


@dataclass(frozen=True)
class FactorSpec:
    build: Callable[..., DataFrame]
    windows: dict


ACC_PAIRS = ((25, 50), (50, 100), (100, 200), (150, 300), (200, 400), (300, 600), (400, 800), (500, 1000), (600, 1200))
FACTORS: dict[str, FactorSpec] = {
    "bap": FactorSpec(bap, minutes(15, 30, 45, 60, 75)),
    "mom": FactorSpec(mom, minutes(5, 10, 20, 30, 45, 60, 90)),
    "acc_mom": FactorSpec(acc_mom, {f"{s}_{l}t": (s, l) for s, l in ACC_PAIRS}),
    "amp_slice": FactorSpec(amp_slice, ticks(300, 600, 900, 1200, 1500)),
    "rigidity": FactorSpec(rigidity, minutes(10, 20, 30, 45, 60, 90, 105)),
    "neg_skew": FactorSpec(neg_skew, minutes(15, 30, 45, 60)),
    "pv_corr": FactorSpec(pv_corr, ticks(100, 200, 300)),
    "rsrs": FactorSpec(rsrs, minutes(30, 45, 60, 75, 105)),
    "oir": FactorSpec(oir, minutes(15, 30, 45, 60, 75)),
    "ofd": FactorSpec(ofd, minutes(15, 30, 45, 60, 75)),
}


def register(name: str, build: Callable[..., DataFrame], windows: dict) -> None:
    """Add a factor of one's own: build(df, windows, by, order) -> df with {name}_{label} and {name}_{label}_has_limit."""
    FACTORS[name] = FactorSpec(build, windows)


def factor_columns(df: DataFrame, name: str) -> list[str]:
    """OP-64: a factor's value columns."""
    return [c for c in df.columns if c.startswith(f"{name}_") and not c.endswith("_has_limit")]


def run_factor(base: DataFrame, name: str, by: By = ("date", "security_id"), order: str = "tick_idx", windows: dict | None = None, **options) -> DataFrame:
    """OP-54: the factor's columns beside all others.

    Options of the factors here: keep (the columns wanted of base beside by, order and the factor's own), tasks (how many the rows are dealt to), placed (each of by is in one task already).
    """
    spec = FACTORS[name]
    return spec.build(base, spec.windows if windows is None else windows, by, order, **options)


def factor_summary(df: DataFrame, name: str, by: By = ("date", "security_id"), expected: DataFrame | None = None) -> DataFrame:
    """OP-54: rows and numbers of values that are not missing.

    expected (by, Rows), the ticks that base has, adds Status: OK, or FAIL where rows were lost or came twice; each of by that is expected has its row.
    """
    found = df.groupBy(*by).agg(F.count("*").alias("Rows"), *[F.count(c).alias(f"nnz_{c}") for c in factor_columns(df, name)])
    if expected is None:
        return found
    joined = expected.select(*by, F.col("Rows").alias("_wanted")).join(found, list(by), "left")
    rows = F.coalesce("Rows", F.lit(0))
    status = F.when(rows == F.col("_wanted"), "OK").otherwise(F.concat(F.lit("FAIL: "), rows, F.lit(" of "), "_wanted", F.lit(" rows")))
    return joined.select(*by, status.alias("Status"), *[c for c in found.columns if c not in by])
