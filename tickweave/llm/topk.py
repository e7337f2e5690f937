"""Exact top-k by inner product over norm-sorted vectors.

Vectors are range-sorted by falling length (then by a hash, so that equal lengths spread) into bands, queries dealt into blocks; both of bounded size. A
query's threshold starts from the longest HEAD vectors: its k-th best product among them. It goes to the bands whose longest vector it
could reach that threshold with (Cauchy-Schwarz on whole lengths: a beginning of the bands), and each band to the blocks that need it.
Each pair of a band and a block is one group of one stage, which goes through the band in order, a chunk of vectors at a time:

- Cauchy-Schwarz on whole lengths: queries whose |q| * |longest left| is under their threshold are done with the band; when all are, the rest is skipped.
- Rotated partial sums in several steps: in the basis of a singular value decomposition (of a bounded sample, SAMPLE rows) the first coordinates hold most
  of the product. Each step of STEPS adds more coordinates to the partial sums of the pairs that are left, and drops those whose partial sum plus
  |q rest| * |x rest| is under the threshold; queries and vectors without pairs leave the step's matrices.
- What is left after the last step gets its exact product in whole numbers, and thresholds rise.

The rotation changes only how much is pruned; bounds have a margin for rounding. Each group gives its k best of each query at most, and
a window over those picks the k best.

Cases: vectors that are null or have a null or non-finite component take no part, nor do null ids; shorter vectors count as filled up with zeros; an empty vector
scores 0; a query's own id is no candidate for it; rows that repeat a query's id all ask, and their best share that id's k places; other repeated rows count one by one;
products beyond 64 bits are cut to the largest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, partitions_for, table

SCALE = 256
QUERY_BLOCK = 8192  # queries in a block, about
BAND = 16_384  # vectors in a band, about
HEAD = 128  # vectors the first thresholds come from: far fewer than a band, so these pairs, which the bands see again, are a small part of all
SAMPLE = 4096  # vectors that the rotation is fitted on, about
CHUNK = 512  # vectors at once
STEPS = (0.125, 0.25, 0.5, 1.0)  # parts of the coordinates in the partial sums


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; NULL if any is missing or not finite."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(values, lambda x: F.floor(x * scale)))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products of whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**62:
        return np.einsum("ij,ij->i", a, b)
    full = (a.astype(object) * b.astype(object)).sum(1)
    return np.array([min(max(int(x), 1 - 2**63), 2**63 - 1) for x in full], np.int64)


def padded(lists: pa.Array, width: int) -> np.ndarray:
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < at[:, None]] = flat
    return out


class PairCounts(AccumulatorParam):
    """Pairs dropped by whole lengths, by each step of the partial sums, and those that got their exact product."""

    def zero(self, value: list) -> list:
        return [0] * (len(STEPS) + 2)

    def addInPlace(self, a: list, b: list) -> list:  # noqa: N802
        return [x + y for x, y in zip(a, b)]


class Block:
    """Some queries with the best found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.rotation = ids, vectors, k, rotation
        width = rotation.shape[1]
        self.ends = [max(1, int(width * part)) for part in STEPS] if width else []
        self.rotated = vectors @ rotation
        self.rest = [np.sqrt((self.rotated[:, end:] ** 2).sum(1)) for end in self.ends]
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.threshold = np.full(len(ids), -np.inf) if floor is None else floor.copy()  # nothing below can be among the k best
        self.query, self.found, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.counts = [0] * (len(STEPS) + 2)

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in vectors in order of falling length."""
        for at in range(0, len(ids), CHUNK):
            x, own = vectors[at : at + CHUNK], ids[at : at + CHUNK]
            norm = np.sqrt((x.astype(float) ** 2).sum(1))
            margin = 1e-9 * self.norm * norm[0] + 1e-6
            live = np.flatnonzero(self.norm * norm[0] + margin >= self.threshold)
            self.counts[0] += (len(self.ids) - len(live)) * len(x)
            if not len(live):
                self.counts[0] += len(self.ids) * (len(ids) - at - len(x))
                return
            row, col = self._left(live, x @ self.rotation, margin)
            other = self.ids[row] != own[col]
            row, col = row[other], col[other]
            self.counts[-1] += len(row)
            for part in range(0, len(row), 65536):  # of a chunk's pairs
                r, c = row[part : part + 65536], col[part : part + 65536]
                score = exact(self.vectors[r], x[c])
                keep = score >= self.threshold[r]
                self._merge(r[keep], own[c[keep]], score[keep])

    def _left(self, row: np.ndarray, rotated: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of the pairs whose bound holds after every step."""
        col, begin = np.arange(len(rotated)), 0
        partial, alive = np.zeros((len(row), len(col))), np.ones((len(row), len(col)), bool)
        for step, end in enumerate(self.ends):
            partial += self.rotated[row, begin:end] @ rotated[col, begin:end].T
            rest = np.sqrt((rotated[col, end:] ** 2).sum(1))
            before = int(alive.sum())
            alive &= partial + np.outer(self.rest[step][row], rest) >= (self.threshold - margin)[row, None]
            self.counts[1 + step] += before - int(alive.sum())
            rows, cols, begin = alive.any(1), alive.any(0), end
            if not (rows.all() and cols.all()):
                row, col = row[rows], col[cols]
                partial, alive = partial[rows][:, cols], alive[rows][:, cols]
        q, c = np.nonzero(alive)
        return row[q], col[c]

    def _merge(self, row: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        row, found, score = (np.concatenate(p) for p in ((self.query, row), (self.found, found), (self.score, score)))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.query, self.found, self.score = (v[place < self.k] for v in (row, found, score))
        last = place == self.k - 1
        self.threshold[row[last]] = np.maximum(self.threshold[row[last]], score[last])


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, report: Accumulator | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query holds, against all rows. report: an accumulator of PairCounts, of the first thresholds' pairs and of all bands'."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("q"), is_query.alias("asks"))
    rows = rows.filter("vec_id is not null and q is not null")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = checkpointed(rows.withColumn("norm", norm))
    total, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = width or 0

    def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
        whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        return padded(whole if len(whole) else pa.array([], pa.list_(pa.int64())), width)

    chance = min(1.0, SAMPLE / max(total, 1))
    sample = rows if chance == 1.0 else rows.filter(F.xxhash64("vec_id", F.lit(8)) < F.lit(int((2 * chance - 1) * 2**63)))
    fitted = matrix(sample.select("q").toArrow()["q"]).astype(float)
    # the right singular vectors, largest first, from the width x width product
    rotation = np.linalg.eigh(fitted.T @ fitted)[1][:, ::-1]
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).select("vec_id", "q").toArrow()
    head_ids, head = longest["vec_id"].to_numpy(), matrix(longest["q"])

    # bands: equal lengths (all rows may have one) are told apart by a hash
    ranged = rows.repartitionByRange(partitions_for(total, BAND), F.desc("norm"), F.xxhash64("vec_id", "q"))
    banded = checkpointed(ranged.select("vec_id", "q", "norm", F.spark_partition_id().alias("band")))  # falling lengths from band to band
    tops = {r["band"]: r["top"] for r in banded.groupBy("band").agg(F.max("norm").alias("top")).collect()}  # a row a band
    reach = np.array([tops.get(b, np.inf) for b in range(max(tops, default=-1) + 1)])
    reach = np.minimum.accumulate(reach)  # an empty band is as good as the one before

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Thresholds from the longest vectors, and the last band that each query needs."""
        for batch in batches:
            own = Block(batch.column(0).to_numpy(), matrix(batch.column(1)), rotation, k)
            own.scan(head_ids, head)
            if report is not None:
                report.add(own.counts)
            least = (own.threshold - 1e-6) / np.maximum(own.norm, 1e-300) * (1 - 1e-9)
            # a negative threshold (or none) can be reached with any vector
            last = np.where(own.threshold > 0, np.searchsorted(-reach, -least, side="right"), len(reach)) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own.threshold), pa.array(last, pa.int32())], ["vec_id", "q", "block", "floor", "last"])

    asking = rows.filter("asks").select("vec_id", "q")
    blocks = partitions_for(asking.count(), QUERY_BLOCK)
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id", "q", F.lit(9)), F.lit(blocks)).cast("int"))
    asking = checkpointed(asking.mapInArrow(begin, "vec_id long, q array<long>, block int, floor double, last int").filter("last >= 0"))
    needs = asking.groupBy("block").agg(F.max("last").alias("last")).select("block", F.explode(F.sequence(F.lit(0), "last")).alias("of"))
    sent = banded.join(needs, F.col("band") == F.col("of")).select("vec_id", "q", "norm", F.col("band").alias("at_band"), F.col("block").alias("at_block"))
    asked = asking.select("vec_id", "q", "block", "floor", F.explode(F.sequence(F.lit(0), "last")).alias("band"))

    def search(queries: pa.Table, band: pa.Table) -> pa.Table:
        band = band.sort_by([("norm", "descending")])
        own = Block(queries["vec_id"].to_numpy(), matrix(queries["q"]), rotation, k, queries["floor"].to_numpy())
        own.scan(band["vec_id"].to_numpy(), matrix(band["q"]))
        if report is not None:
            report.add(own.counts)
        return pa.table({"query_id": own.ids[own.query], "vec_id": own.found, "score": own.score})

    every = asked.groupBy("band", "block").cogroup(sent.groupBy("at_band", "at_block")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
