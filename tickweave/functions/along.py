"""Rolling windows along dealt rows: Spark deals, cuts and sorts the rows, numpy steps over them in Arrow batches.

`dealt` puts the rows of each group together and in order. Where places in the group are known (a column `_pos`: 0, 1, ... in order), long groups are cut into stretches (`_part`),
each with the last rows of the one before, so that a group of any length takes many tasks. `along` then adds columns: a function sees a batch with the `back` rows before it as numpy
arrays (Rows), so nothing is held but a batch. As in functions.windows a window is put together from its own rows alone, on the ladder of lengths found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tickweave.functions.windows import ladder, rungs_of

TASK = 250_000  # rows that a task is meant to take
STRETCH = 20_000  # rows of a stretch, at least, without those of the one before
State = dict[str, np.ndarray]
Parts = list[tuple[State, int, int]]  # (a stretch's state, how many rows back it ends, its length)


def tasks_for(spark: SparkSession, rows: int, a_task: int = TASK) -> int:
    """Tasks for so many rows: as many as the session says, more where these would get more rows than that each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // a_task))


def dealt(df: DataFrame, by: Iterable[str], order: str, back: int, tasks: int | None = None, placed: bool = False) -> DataFrame:
    """Each of by in one task and in order, or in stretches of that kind; `_part` tells them apart. placed: by or some of it is already in one task each."""
    by = list(by)
    if "_part" in df.columns:
        return df
    length, part = max(STRETCH, 8 * back), F.lit(0)
    if "_pos" in df.columns:
        own = F.floor(F.col("_pos") / length).cast("int")
        part = F.explode(F.when(F.col("_pos") % length >= length - back, F.array(own, own + 1)).otherwise(F.array(own)))
        placed = False
    df = df.withColumn("_part", part)
    if not placed:
        df = df.repartition(*([tasks] if tasks else []), *by, "_part")
    return df.sortWithinPartitions(*by, "_part", order)


def stretch_rows(df: DataFrame, back: int) -> DataFrame:
    """What `dealt` took over from the stretch before goes."""
    return df.filter(F.col("_part") == F.floor(F.col("_pos") / max(STRETCH, 8 * back)))


class Rows:
    """The rows of a batch and some before it; pos counts the rows of each group, at is that of the rows that count in the arrays."""

    def __init__(self, pos: np.ndarray):
        self.pos, self.at = pos, np.arange(len(pos))

    def lag(self, x: np.ndarray, k: int, none: float | int | bool = np.nan) -> np.ndarray:
        if not k:
            return x
        out = np.full(len(x), none, dtype=x.dtype)
        out[k:] = x[:-k]
        out[self.pos < k] = none
        return out

    def count(self, there: np.ndarray, w: int) -> np.ndarray:
        """How many of the last w rows."""
        runs = np.concatenate([[0], np.cumsum(there, dtype=np.int64)])
        return runs[self.at + 1] - runs[np.maximum(self.at - np.minimum(self.pos, w - 1), 0)]

    def states(self, state: State, windows: Iterable[int], merge: Callable[[Parts], State], none: dict[str, float]) -> dict[int, State]:
        """The state of the last w rows for each window, from that of each row; none is the state of rows that are not there."""
        windows = sorted(set(windows))
        lengths = ladder(windows)
        rungs = {1: state}
        seen = lambda n, back: {k: self.lag(v, back, none[k]) for k, v in rungs[n].items()}
        for short, long in zip(lengths, lengths[1:]):
            rungs[long] = merge([(seen(short, k * short), k * short, short) for k in range(long // short)])
        return {w: merge([(seen(n, back), back, n) for n, back in rungs_of(w, lengths)]) for w in windows}

    def sums(self, x: np.ndarray, windows: Iterable[int]) -> dict[int, np.ndarray]:
        """Missing values count as 0."""
        found = self.states({"s": np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)}, windows, lambda parts: {"s": sum(p["s"] for p, *_ in parts)}, {"s": 0.0})
        return {w: v["s"] for w, v in found.items()}

    def moments(self, x: np.ndarray, windows: Iterable[int]) -> dict[int, State]:
        """Mean, and sums of squares and cubes about it, of whole windows; a missing value makes all missing."""

        def merge(parts: Parts) -> State:
            total = sum(n for *_, n in parts)
            mean = sum(p["x"] * (n / total) for p, _, n in parts)
            by = [p["x"] - mean for p, *_ in parts]
            xx = sum(p["xx"] + n * d * d for d, (p, _, n) in zip(by, parts))
            return {"x": mean, "xx": xx, "xxx": sum(p["xxx"] + d * (3 * p["xx"] + n * d * d) for d, (p, _, n) in zip(by, parts))}

        nothing = np.zeros(len(x))
        return self.states({"x": x, "xx": nothing, "xxx": nothing}, windows, merge, dict.fromkeys(("x", "xx", "xxx"), np.nan))

    def comoments(self, x: np.ndarray, y: np.ndarray, windows: Iterable[int]) -> dict[int, State]:
        """Over the rows that have both: n, means, and sums of squares (xx) and products (xy) about them."""

        def merge(parts: Parts) -> State:
            n = sum(p["n"] for p, *_ in parts)
            mean = {c: np.divide(sum(p["n"] * p[c] for p, *_ in parts), n, out=np.zeros(len(n)), where=n > 0) for c in "xy"}
            by = [{c: p[c] - mean[c] for c in "xy"} for p, *_ in parts]
            about = {f"x{c}": sum(p[f"x{c}"] + p["n"] * d["x"] * d[c] for d, (p, *_) in zip(by, parts)) for c in "xy"}
            return {"n": n, **mean, **about}

        there = ~(np.isnan(x) | np.isnan(y))
        nothing = np.zeros(len(x))
        one = {"n": there.astype(float), "x": np.where(there, x, 0.0), "y": np.where(there, y, 0.0), "xx": nothing, "xy": nothing}
        return self.states(one, windows, merge, dict.fromkeys(one, 0.0))

    def changed(self, x: np.ndarray) -> np.ndarray:
        """Which rows have a value other than the last one before them, of whatever group."""
        there = np.flatnonzero(~np.isnan(x))
        out = np.zeros(len(x), bool)
        out[there[1:]] = x[there[1:]] != x[there[:-1]]
        return out

    def constant(self, x: np.ndarray, w: int) -> np.ndarray:
        """Whether the last w rows, none of them missing and all of one group, have one value: the last change is not after the first of them."""
        return np.maximum.accumulate(np.where(self.changed(x), self.at, -1)) <= self.at - (w - 1)

    def varies(self, x: np.ndarray, w: int) -> np.ndarray:
        """Whether the last w rows, some of them missing, have more than one value: the last change is after the first one that is there."""
        runs = np.cumsum(~np.isnan(x))
        return np.maximum.accumulate(np.where(self.changed(x), runs, 0)) > runs - self.count(~np.isnan(x), w) + 1


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_boolean(column.type):
        return column.fill_null(False).to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def along(df: DataFrame, by: Iterable[str], inputs: list[str], out: str, f: Callable[[Rows, State], dict], back: int) -> DataFrame:
    """Add the columns `out` (a schema in DDL) that f makes of the numbers and conditions `inputs`; rows are dealt. Missing numbers are NaN on both sides, missing conditions false.

    A column `_pos` of the places in the group is added where there is none; `inputs` go.
    """
    by, placed = [*by, "_part"], "_pos" in df.columns
    keep = [c for c in df.columns if c not in inputs]
    fields = StructType.fromDDL(out).fields if out else []
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[x.dataType.simpleString()] for x in fields]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pos, before = np.zeros(0, np.int64), np.zeros(0, np.int64), {c: None for c in inputs}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, old = batch["_key"].to_numpy(), len(keys)
            keys = np.concatenate([keys, own])
            at = np.arange(len(keys))
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            ahead = at[old:] - np.maximum.accumulate(np.where(first, at, 0))[old:]  # of groups that begin here
            if old:
                begun = np.logical_or.accumulate(first[old:])
                ahead = np.where(begun, ahead, pos[-1] + 1 + at[: len(own)])
            pos = np.concatenate([pos, ahead])
            values = {c: _numbers(batch[c]) if before[c] is None else np.concatenate([before[c], _numbers(batch[c])]) for c in inputs}
            with np.errstate(all="ignore"):
                found = f(Rows(pos), values)
            columns = [batch[c] for c in keep]
            if not placed:
                columns.append(pa.array(pos[old:]))
            for field, kind in zip(fields, types):
                columns.append(pa.array(found[field.name][old:], kind, from_pandas=pa.types.is_floating(kind)))
            yield pa.RecordBatch.from_arrays(columns, names)
            rest = slice(max(len(keys) - max(back, 1), 0), None)
            keys, pos, before = keys[rest], pos[rest], {c: v[rest] for c, v in values.items()}

    names = [*keep, *([] if placed else ["_pos"]), *[x.name for x in fields]]
    schema = StructType(list(df.select(keep).schema.fields))
    if not placed:
        schema = schema.add("_pos", LongType())
    for x in fields:
        schema = schema.add(x)
    return df.withColumn("_key", F.xxhash64(*by)).mapInArrow(steps, schema)
