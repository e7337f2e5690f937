"""Whitening of embeddings: projection on the leading eigenvectors of their covariance, each to variance one.

Two passes over the fit list (each distinct vector once, written to the shared folder): sums by dimension, then the covariance of what is
already centred. A task adds up one matrix of its batches and sends its upper triangle, so what meets in the driver has width x width numbers,
however many rows there are. There the matrix is made tridiagonal by Householder reflections, its leading eigenvalues are bracketed by bisection on Sturm counts, and
their vectors come from inverse iteration, made orthogonal to those of close eigenvalues before. Every row is projected where it lies: the model, a few vectors of that width,
goes out with the task. A third pass over the fit list measures how far the whitened covariance is from the identity.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up with zeros; null and repeated ids
are rows like others. A component without variance (an eigenvalue that is nothing but rounding) has no whitened value (NULL) and explains 0. Without any width (empty
vectors alone), or without rows, there is no component and so no row. Components past the 64 bits of a long are cut to its ends, and so is `deviation`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.common import checkpointed, small_batches, table
from tickweave.llm.topk import padded, whole_numbers

SCALE = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
CLOSE = 1e-3  # eigenvalues nearer than this share of the norm are made orthogonal to each other
LONG = 2**63 - 1


# ---- eigenvectors of a symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, beside it, reflectors): Q' V Q is tridiagonal, Q the product of I - 2 u u' over the reflectors (first row of u, unit vector u)."""
    a, reflectors = np.array(v, float), []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size == 0 or not np.abs(u[1:]).max(initial=0):
            continue
        u[0] += np.copysign(size, u[0])
        u /= np.linalg.norm(u)
        # a two-sided reflection is a change of rank two
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = p - (u @ p) * u
        rest -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflectors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def counts_below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm: how many eigenvalues lie below each of `at`, by the signs of the pivots of T - x I."""
    least = max(EPS * EPS * max(float(np.abs(diagonal).max(initial=0)), float(np.abs(beside).max(initial=0))), 1e-300)
    below, pivot = np.zeros(len(at), int), np.ones(len(at))
    for k, d in enumerate(diagonal):
        pivot = d - at - (beside[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling; brackets from Gershgorin's discs are halved until no number lies between."""
    n = len(diagonal)
    radius = np.abs(np.append(beside, 0.0)) + np.abs(np.append(0.0, beside)) if n else np.zeros(0)
    reach = float((np.abs(diagonal) + radius).max(initial=0)) * (1 + 4 * EPS) + 1e-300
    low, high = np.full(k, -reach), np.full(k, reach)
    wanted = n - np.arange(k)  # the j-th largest: that many are below or equal
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any() or (high - low).max(initial=0) <= EPS * reach * 1e-3:
            return middle
        under = counts_below(diagonal, beside, middle) >= wanted
        low, high = np.where(under, low, middle), np.where(under, middle, high)


def shifted_solver(diagonal: np.ndarray, beside: np.ndarray, value: float, norm: float):
    """Solve (T - value I) x = b by Gaussian elimination with row exchanges, factored once; pivots of nought become tiny."""
    n, tiny = len(diagonal), max(EPS * norm, 1e-300)
    upper = np.zeros((n, 3))  # each row's pivot and the two after it
    steps = []
    row = [diagonal[0] - value, beside[0] if n > 1 else 0.0, 0.0]
    for k in range(n - 1):
        after = [beside[k], diagonal[k + 1] - value, beside[k + 1] if k + 2 < n else 0.0]
        swap = abs(after[0]) > abs(row[0])
        first, second = (after, row) if swap else (row, after)
        pivot = first[0] if abs(first[0]) > tiny else tiny
        factor = second[0] / pivot
        upper[k] = pivot, first[1], first[2]
        steps.append((swap, factor))
        row = [second[1] - factor * first[1], second[2] - factor * first[2], 0.0]
    upper[n - 1, 0] = row[0] if abs(row[0]) > tiny else tiny

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k, (swap, factor) in enumerate(steps):
            if swap:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor * x[k]
        for k in range(n - 1, -1, -1):
            x[k] -= upper[k, 1] * x[k + 1] if k + 1 < n else 0.0
            x[k] -= upper[k, 2] * x[k + 2] if k + 2 < n else 0.0
            x[k] /= upper[k, 0]
        return x

    return solve


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, a column each; those of a cluster of close eigenvalues are made orthogonal in every round."""
    n, norm = len(diagonal), max(float(np.abs(diagonal).max(initial=0)), float(np.abs(beside).max(initial=0)), 1e-300)
    vectors, random = np.zeros((n, len(values))), np.random.default_rng(0)
    begin = 0  # of the cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            begin = j
        solve, x = shifted_solver(diagonal, beside, value, norm), random.normal(size=n)
        for _ in range(rounds):
            for _ in range(2):
                x -= vectors[:, begin:j] @ (vectors[:, begin:j].T @ x)
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= vectors[:, begin:j] @ (vectors[:, begin:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    return vectors


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors (columns; each one's largest entry is positive)."""
    k = min(k, len(v))
    diagonal, beside, reflectors = tridiagonal(v)
    values = leading_eigenvalues(diagonal, beside, k)
    vectors = inverse_iteration(diagonal, beside, values)
    for begin, u in reversed(reflectors):
        vectors[begin:] -= 2 * np.outer(u, u @ vectors[begin:])
    top = np.abs(vectors).argmax(0) if k else np.zeros(0, int)
    return values, vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)


# ---- the distributed parts


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list, their exact sums by dimension, eigenvalues, components (columns), what each explains; scale: 1 / sqrt(e), NaN without variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    scale: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.components) * self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most**2 * max(len(self.sums), 1) < LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        apart = self.n * x.astype(object) - np.array(self.sums, object)
        return [min(int(d), LONG) for d in (apart**2).sum(1)]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return padded(lists, width)


def covariance(fit: DataFrame, column: str, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, V) of a column of whole-number vectors; V has the divisor n."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            small = int(np.abs(x).max(initial=0)) < 2**31 and len(x) < 2**31
            n, sums = n + len(x), sums + (x.sum(0) if small else x.astype(object).sum(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(int(s)) for s in (n, *sums)], pa.decimal128(38, 0))], ["i", "s"])

    # a row for each dimension, and the number of rows at -1
    found = {r["i"]: int(r["s"]) for r in fit.select(column).mapInArrow(summed, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    n, sums = found.get(-1, 0), [found.get(i, 0) for i in range(width)]
    mean = np.array([s / max(n, 1) for s in sums])
    above = np.triu_indices(width)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((width, width)), False
        for batch in batches:
            centred = _matrix(batch.column(0), width) - mean
            total += centred.T @ centred
            any_row |= len(centred) > 0
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(above[0].astype(np.int32)), pa.array(above[1].astype(np.int32)), pa.array(total[above])], ["i", "j", "v"])

    parts = fit.select(column).mapInArrow(multiplied, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    v = np.zeros((width, width))
    i, j = parts["i"].to_numpy(), parts["j"].to_numpy()
    v[i, j] = v[j, i] = parts["v"].to_numpy() / max(n, 1)
    return n, sums, v


def _longs(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """All rows with their whole numbers in `_x`; without those that take no part."""
    return small_batches(vectors).withColumn("_x", whole_numbers(F.col(vector_col), scale)).filter("_x is not null")


def fit_list(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """Each distinct vector once (column x, repeats combined before the exchange), and the width; zeros at the end don't tell two vectors apart."""
    rows = _longs(vectors, vector_col, scale).select(F.col("_x").alias("x"))
    last = F.array_position(F.transform(F.reverse("x"), lambda c: c != 0), True).cast("int")  # of the nonzero ones, from the end
    used = F.when(last == 0, 0).otherwise(F.size("x") - last + 1)
    fit = checkpointed(rows.withColumn("_width", F.size("x")).groupBy(F.slice("x", 1, used).alias("x")).agg(F.max("_width").alias("width")))
    return fit, fit.agg(F.max("width")).first()[0] or 0


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding", scale: int = SCALE) -> tuple[Whitening, DataFrame]:
    """The model, and its fit list (column x)."""
    fit, width = fit_list(vectors, vector_col, scale)
    n, sums, v = covariance(fit, "x", width)
    values, axes = leading_eigenpairs(v, components)
    there = values > 8 * width * EPS * float(np.abs(v).max(initial=0))
    total = float(np.trace(v))
    inverse = np.where(there, 1 / np.sqrt(np.where(there, values, 1.0)), np.nan)
    return Whitening(n, sums, values, axes, np.where(there, values, 0.0) / (total or 1.0), inverse), fit


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """All rows that take part, all their columns, with whitened array<double> and deviation long (columns of these names are replaced)."""
    rows = _longs(vectors.drop("whitened", "deviation", "_x"), vector_col, scale)
    width, at = len(model.sums), len(rows.columns) - 1

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at), width)
            ends = np.arange(len(x) + 1, dtype=np.int32) * model.components.shape[1]
            values = pa.array(model.project(x).ravel(), mask=np.isnan(np.tile(model.scale, len(x))))
            own = [c for k, c in enumerate(batch.columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(ends, values), pa.array(model.deviations(x), pa.int64())], [*names, "whitened", "deviation"])

    schema = rows.drop("_x").schema.add("whitened", T.ArrayType(T.DoubleType())).add("deviation", T.LongType())
    return rows.mapInArrow(projected, schema)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity, over the components that have variance."""
    own = [k for k in range(len(model.values)) if not np.isnan(model.scale[k])]
    if not own or not model.n:
        return 0.0
    axes = Whitening(model.n, model.sums, model.values[own], model.components[:, own], model.explained[own], model.scale[own])
    whitened = whiten(fit.select("x"), axes, "x", 1).select(*[F.get("whitened", k).alias(f"w{k}") for k in range(len(own))])
    pairs = [(i, j) for i in range(len(own)) for j in range(i, len(own))]
    # covar_pop is centred as it goes
    found = whitened.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model, fit = fit_whitening(rows)
    error = identity_error(fit, model)
    whitened = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in model.explained], F.lit(0.0)), F.col("at") + 1)
    return whitened.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
