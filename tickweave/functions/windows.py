"""Rolling windows by row count, without moving frames.

A moving frame is evaluated anew for each row. Counts, which are exact, are the running count less the running count w rows ago. Sums of floats would carry
the rounding of everything before the window that way, so they are put together from the window's own rows alone: the state of the last 4 rows from
four single rows, that of 20 from five of these and so on (a ladder of lengths), and a window from a few rungs, the later ones seen some rows back. A state is what two stretches
can be merged by: sums, centred moments, or powers of places. All steps have one partition and order: one exchange and one sort for any number of windows and inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickweave.functions.exprs import add_up, div, flag


def rows_of(by: Iterable[str], order: str) -> WindowSpec:
    return W.partitionBy(*by).orderBy(order)


def growing(by: Iterable[str], order: str) -> WindowSpec:
    return rows_of(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def with_position(df: DataFrame, by: Iterable[str], order: str, name: str = "_pos") -> DataFrame:
    """The 0-based place of each row in its partition."""
    return df.withColumn(name, F.row_number().over(rows_of(by, order)) - 1)


def rolling_sums(df: DataFrame, by: Iterable[str], order: str, inputs: Mapping[str, tuple[Column, Iterable[int]]]) -> DataFrame:
    """For each name: (value, windows) the columns name_w, the sum of whole numbers over the last w rows (fewer at the start), as a difference of running sums; NULL counts as 0."""
    by = list(by)
    zero = lambda v: F.coalesce(v, F.lit(0))
    runs = df.withColumns({f"_run_{k}": F.sum(zero(v)).over(growing(by, order)) for k, (v, _) in inputs.items()})
    lagged = rows_of(by, order)
    sums = {f"{k}_{w}": F.col(f"_run_{k}") - zero(F.lag(f"_run_{k}", w).over(lagged)) for k, (_, ws) in inputs.items() for w in dict.fromkeys(ws)}
    return runs.withColumns(sums).drop(*[f"_run_{k}" for k in inputs])


#: A rung is at most that many times the one below it, and a window at most about that many of the top one.
RUNGS = 8
Parts = list[tuple[str, int, int]]  # (column of a stretch's state, how many rows back it ends, its length)
Merge = Callable[[DataFrame, Parts, str], DataFrame]  # adds the state of the stretches together


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while n > 1:
        while n % p == 0:
            found.append(p)
            n //= p
        p += 1
    return found


def ladder(windows: Iterable[int]) -> list[int]:
    """Lengths from 1 up, each a small multiple of the one before, of which every window is made of few."""
    windows = sorted(set(windows))
    common = gcd(*windows)
    primes = _primes(common)
    if primes and primes[-1] > RUNGS * RUNGS:
        common, primes = 1, []
    steps, now = [], 1
    for p in primes:
        if now * p > RUNGS and now > 1:
            steps.append(now)
            now = 1
        now *= p
    steps += [now] if now > 1 else []
    lengths = [1]
    for k in steps:
        lengths.append(lengths[-1] * k)
    while windows[-1] // lengths[-1] > RUNGS:
        lengths.append(lengths[-1] * (RUNGS // 2))
    return lengths


def rungs_of(w: int, lengths: list[int]) -> list[tuple[int, int]]:
    """(length, rows back) of the stretches that make up the last w rows."""
    out, back = [], 0
    for length in reversed(lengths):
        while w - back >= length:
            out.append((length, back))
            back += length
    return out


def rolling_states(df: DataFrame, by: Iterable[str], order: str, state: str, windows: Iterable[int], merge: Merge, last: Callable[[int], Merge] | None = None) -> DataFrame:
    """Add {state}_{w} for each window: the state of the last w rows (fewer at the start), from `state`, that of each row. Only the rows of the window have a part in it.

    last: how the stretches of a window are merged, if not everything of the state is wanted of each.
    """
    windows, rows, before = sorted(set(windows)), rows_of(by, order), df.columns
    lengths = ladder(windows)
    at = {1: state} | {length: f"_{state}_rung{length}" for length in lengths[1:]}

    def seen(df: DataFrame, stretches: Iterable[tuple[int, int]]) -> tuple[DataFrame, dict[tuple[int, int], str]]:
        names = {(n, back): f"_{state}_{n}_back{back}" if back else at[n] for n, back in stretches}
        return df.withColumns({name: F.lag(at[n], back).over(rows) for (n, back), name in names.items() if back}), names

    for short, long in zip(lengths, lengths[1:]):
        df, names = seen(df, [(short, k * short) for k in range(long // short)])
        df = merge(df, [(name, back, n) for (n, back), name in names.items()], at[long]).drop(*[n for n in names.values() if n != at[short]])
    df, names = seen(df, sorted({s for w in windows for s in rungs_of(w, lengths)}))
    for w in windows:
        df = (last(w) if last else merge)(df, [(names[s], s[1], s[0]) for s in rungs_of(w, lengths)], f"{state}_{w}")
    return df.select(*before, *[f"{state}_{w}" for w in windows])


def _there(part: str, field: str, none: float | int = 0.0) -> Column:
    return F.coalesce(F.col(part)[field], F.lit(none))


def local_sums(df: DataFrame, by: Iterable[str], order: str, values: Mapping[str, tuple[Column, Iterable[int]]]) -> DataFrame:
    """For each name: (value, windows) the columns {name}_{w}, the sum over the last w rows, from these rows alone; NULL counts as 0."""
    before, wanted = df.columns, {k: list(dict.fromkeys(ws)) for k, (_, ws) in values.items()}

    def merged(names: list[str]) -> Merge:
        return lambda df, parts, out: df.withColumn(out, F.struct(*[add_up(*[_there(p, k) for p, *_ in parts]).alias(k) for k in names]))

    df = df.withColumn("_sums", F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, (v, _) in values.items()]))
    every = sorted({w for ws in wanted.values() for w in ws})
    df = rolling_states(df, by, order, "_sums", every, merged(list(values)), lambda w: merged([k for k, ws in wanted.items() if w in ws]))
    return df.select(*before, *[F.col(f"_sums_{w}")[k].alias(f"{k}_{w}") for k, ws in wanted.items() for w in ws])


def local_moments(df: DataFrame, by: Iterable[str], order: str, values: Mapping[str, tuple[Column, Iterable[int]]], cubes: bool = False) -> DataFrame:
    """For each name: (value, windows) the structs {name}_{w} of centred moments over the last w rows: x, xx[, xxx] (mean, sums of squares and cubes about it).

    Only whole windows have them: a missing value, or too few rows, makes all NULL.
    """
    wanted = {k: list(dict.fromkeys(ws)) for k, (_, ws) in values.items()}
    fields = ("x", "xx", *(["xxx"] if cubes else []))

    def merged(names: list[str]) -> Merge:
        def merge(df: DataFrame, parts: Parts, out: str) -> DataFrame:
            total = sum(n for *_, n in parts)
            df = df.withColumns({f"_{k}_x": add_up(*[F.col(p)[f"{k}_x"] * F.lit(n / total) for p, _, n in parts]) for k in names})
            # how far each stretch's mean lies from the common one
            df = df.withColumns({f"_{k}_d{i}": F.col(p)[f"{k}_x"] - F.col(f"_{k}_x") for k in names for i, (p, *_) in enumerate(parts)})
            found = []
            for k in names:
                d = lambda i: F.col(f"_{k}_d{i}")  # noqa: E731, B023
                found += [F.col(f"_{k}_x").alias(f"{k}_x"), add_up(*[F.col(p)[f"{k}_xx"] + n * d(i) * d(i) for i, (p, _, n) in enumerate(parts)]).alias(f"{k}_xx")]
                if cubes:
                    found.append(add_up(*[F.col(p)[f"{k}_xxx"] + d(i) * (3 * F.col(p)[f"{k}_xx"] + n * d(i) * d(i)) for i, (p, _, n) in enumerate(parts)]).alias(f"{k}_xxx"))
            return df.withColumn(out, F.struct(*found)).drop(*[f"_{k}_{c}" for k in names for c in ("x", *(f"d{i}" for i in range(len(parts))))])

        return merge

    before, zero = df.columns, F.lit(0.0)
    one = [c.alias(f"{k}_{f}") for k, (x, _) in values.items() for f, c in zip(fields, (x.cast("double"), zero, zero))]
    every = sorted({w for ws in wanted.values() for w in ws})
    df = rolling_states(df.withColumn("_moments", F.struct(*one)), by, order, "_moments", every, merged(list(values)), lambda w: merged([k for k, ws in wanted.items() if w in ws]))
    out = {f"{k}_{w}": F.struct(*[F.col(f"_moments_{w}")[f"{k}_{c}"].alias(c) for c in fields]) for k, ws in wanted.items() for w in ws}
    return df.select(*before, *[v.alias(k) for k, v in out.items()])


def local_comoments(df: DataFrame, by: Iterable[str], order: str, name: str, x: Column, y: Column, windows: Iterable[int]) -> DataFrame:
    """The structs {name}_{w} over the last w rows that have both: n, x, y (count and means), xx, xy (sums of squares and products about them)."""
    there, zero = x.isNotNull() & y.isNotNull(), F.lit(0.0)

    def merge(df: DataFrame, parts: Parts, out: str) -> DataFrame:
        df = df.withColumn("_n", add_up(*[_there(p, "n") for p, *_ in parts]))
        df = df.withColumns({f"_{c}": F.coalesce(div(add_up(*[_there(p, "n") * _there(p, c) for p, *_ in parts]), F.col("_n")), F.lit(0.0)) for c in "xy"})
        df = df.withColumns({f"_d{c}{k}": _there(p, c) - F.col(f"_{c}") for c in "xy" for k, (p, *_) in enumerate(parts)})
        about = lambda c: add_up(*[_there(p, f"x{c}") + _there(p, "n") * F.col(f"_dx{k}") * F.col(f"_d{c}{k}") for k, (p, *_) in enumerate(parts)])
        df = df.withColumn(out, F.struct(F.col("_n").alias("n"), F.col("_x").alias("x"), F.col("_y").alias("y"), about("x").alias("xx"), about("y").alias("xy")))
        return df.drop("_n", "_x", "_y", *[f"_d{c}{k}" for c in "xy" for k in range(len(parts))])

    row = {"n": F.when(there, 1.0).otherwise(zero), "x": F.when(there, x.cast("double")).otherwise(zero), "y": F.when(there, y.cast("double")).otherwise(zero), "xx": zero, "xy": zero}
    return rolling_states(df.withColumn(name, F.struct(*[v.alias(k) for k, v in row.items()])), by, order, name, windows, merge).drop(name)


def count_of(condition: Column) -> Column:
    """1 where the condition holds, as input of rolling_sums."""
    return flag(condition).cast("long")


def gate(valid_count: Column, w: int, position: Column) -> Column:
    """OP-40: the window is full and at most a tenth of it is invalid, in whole numbers."""
    return (position >= w - 1) & (10 * (F.lit(w) - valid_count) <= w)


def masked_mean(total: Column, count: Column) -> Column:
    """OP-41: the mean of what is valid, if anything is."""
    return div(total, count)


def last_change(value: Column, by: Iterable[str], order: str, position: str = "_pos") -> tuple[Column, Column]:
    """R-05 in two steps: (previous valid value, running place of the last change, given that as `_previous`).

    A window without missing values is constant if and only if its last change is not after its first row.
    """
    previous = F.last(value, ignorenulls=True).over(rows_of(by, order).rowsBetween(W.unboundedPreceding, -1))
    changed = F.when(value.isNotNull() & F.col("_previous").isNotNull() & (value != F.col("_previous")), F.col(position))
    return previous, F.max(changed).over(growing(by, order))
