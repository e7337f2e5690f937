"""SimHash near-duplicates, linked exactly by vantage-point trees.

Fingerprints: a text's words (A-Z lower-cased, split at space and \\x09-\\x0D) give shingles of `shingle` words; a bit is 1 if it is
set in over half of their XXH64 values (seed 42). Texts with fewer words are one shingle; without words the fingerprint is zero.

Links: documents of equal fingerprint form a class; only distinct fingerprints are compared. A vantage-point tree over a
bounded sample divides the space of fingerprints into shards: at each node by the Hamming distance to its vantage
point. A fingerprint is at home in one shard and also visits each shard that could hold one within the radius: by the
triangle inequality those on the far side of a node's boundary only if it lies within the radius of that boundary.
In each shard a local tree over the residents answers all residents and visitors exactly, again pruned by triangle bounds; of
the pairs found only a spanning forest leaves the task. A shard with very many residents is cut into parts by hash, each of which
sees all residents and visitors as queries. Components of the forests' edges come from alternating large-star and small-star rounds.

Cases: a null text has no words; repeated rows and equal texts share a class; a null doc_id gets a fingerprint and a component, but
names none (a component of null ids alone has a null id); an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, in_fewer, small_batches, table, text_or_empty

SHINGLE, SEED, RADIUS = 3, 42, 3
SHARD_FINGERPRINTS = 16_384  # residents of a shard, about
SAMPLE = 65_536  # fingerprints in the sample for the shards' tree, at most about
LEAF = 128  # fingerprints in a leaf of a local tree
EDGES_A_TASK = 250_000


def digests(text: str, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 values of a text's shingles, repeats included, in runs of bounded size."""
    import xxhash

    words = text.encode().lower().split()  # bytes: lower-cases A-Z alone and splits at the six white bytes alone
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(last), 65536):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(begins[k : k + 65536], last[k : k + 65536])], np.uint64)


def majority(runs: Iterable[np.ndarray]) -> int:
    """A bit for each that is set in over half of the values; 0 without values."""
    n, ones = 0, np.zeros(64, np.int64)
    for values in runs:
        n += len(values)
        ones += np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(digests(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. No shuffle."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), of(text_or_empty(text_col)).alias("fp"))


# A tree is a node: ("leaf", number or fingerprints) or ("node", vantage point, boundary, inner, outer);
# inner holds what is at most `boundary` bits away from the vantage point.


def _distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def build_tree(points: np.ndarray, leaf: int, depth: int = 40) -> tuple:
    """A vantage-point tree over distinct fingerprints. The vantage point is the one farthest from the first; the boundary is the median."""
    if len(points) <= leaf or not depth:
        return ("leaf", points)
    vantage = points[np.argmax(_distance(points, points[0]))]
    d = _distance(points, vantage)
    boundary = int(np.partition(d, len(d) // 2)[len(d) // 2])
    inner = d <= boundary
    if inner.all():
        inner = d < boundary
        boundary -= 1
    if not inner.any():
        return ("leaf", points)
    return ("node", vantage, boundary, build_tree(points[inner], leaf, depth - 1), build_tree(points[~inner], leaf, depth - 1))


def number_leaves(tree: tuple, count: int = 0) -> tuple[tuple, int]:
    if tree[0] == "leaf":
        return ("leaf", count), count + 1
    inner, count = number_leaves(tree[3], count)
    outer, count = number_leaves(tree[4], count)
    return ("node", tree[1], tree[2], inner, outer), count


def route(tree: tuple, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf number): every leaf that can hold something within radius of each point. Radius 0: its home."""
    rows, leaves = [], []

    def walk(node: tuple, at: np.ndarray) -> None:
        if not len(at):
            return
        if node[0] == "leaf":
            rows.append(at)
            leaves.append(np.full(len(at), node[1]))
            return
        d = _distance(points[at], node[1])
        walk(node[3], at[d <= node[2] + radius])
        walk(node[4], at[d > node[2] - radius])

    walk(tree, np.arange(len(points)))
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


class Labels:
    """Components of 0 .. n - 1, each named by its least member; whole arrays of pairs are joined at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while (apart := self.of[a] != self.of[b]).any():
            one, other = self.of[a[apart]], self.of[b[apart]]
            np.minimum.at(self.of, np.maximum(one, other), np.minimum(one, other))
            while (up := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = up


def local_links(residents: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query the place of the first query of its component under all pairs (resident, query) within radius.

    Both are sorted and distinct, and the residents are among the queries.
    """
    labels = Labels(len(queries))

    def walk(node: tuple, at: np.ndarray) -> None:
        if not len(at):
            return
        if node[0] == "leaf":
            where = np.searchsorted(queries, node[1])
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                q, p = np.nonzero(np.bitwise_count(queries[part][:, None] ^ node[1][None, :]) <= radius)
                labels.join(part[q], where[p])
        else:
            d = _distance(queries[at], node[1])
            walk(node[3], at[d <= node[2] + radius])
            walk(node[4], at[d > node[2] - radius])

    walk(build_tree(residents, LEAF), np.arange(len(queries)))
    return labels.of


def near_pairs(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_FINGERPRINTS, sample_size: int = SAMPLE) -> DataFrame:
    """distinct (fp), each once, checkpointed -> edges (a, b) whose components are those of all pairs within radius."""
    n = distinct.count()
    shards = max(1, -(-n // shard_size))
    wanted = min(sample_size, max(64 * shards, 256))
    chance = min(1.0, wanted / max(n, 1))
    by_hash = F.xxhash64("fp", F.lit(11))
    sample = distinct if chance == 1.0 else distinct.filter(by_hash < F.lit(int((2 * chance - 1) * 2**63)))
    points = np.sort(np.array([r[0] for r in sample.collect()], np.int64)).view(np.uint64)  # about `wanted` numbers
    tree, leaves = number_leaves(build_tree(points, max(1, len(points) // shards)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = batch["fp"].to_numpy(np.int64).view(np.uint64)
            home = np.empty(len(p), np.int64)
            at, leaf = route(tree, p, 0)
            home[at] = leaf
            rows, to = route(tree, p, radius)
            # a pair at home in two shards is found in the later one, so earlier shards need no visit
            keep = to >= home[rows]
            rows, to = rows[keep], to[keep]
            yield pd.DataFrame({"shard": to.astype(np.int32), "fp": p[rows].view(np.int64), "resident": to == home[rows]})

    sent = checkpointed(distinct.select("fp").mapInPandas(send, "shard int, fp long, resident boolean"))
    # parts of a crowded shard; a shard without residents has nothing to find
    parts = sent.filter("resident").groupBy("shard").agg(F.ceil(F.count("*") / (4 * shard_size)).cast("int").alias("parts"))
    cut = sent.join(parts.withColumnRenamed("shard", "of"), F.col("shard") == F.col("of"))
    own = F.pmod(F.xxhash64("fp", F.lit(12)), F.col("parts")).cast("int")
    dealt = cut.select("shard", "fp", "resident", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = dealt.select("shard", "part", "fp", (F.col("resident") & (F.col("own") == F.col("part"))).alias("resident"))

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(p)
        p, resident = p[order], rows["resident"].to_numpy(bool)[order]
        root = p[local_links(p[resident], p, radius)]
        linked = root != p
        return pd.DataFrame({"a": p[linked].view(np.int64), "b": root[linked].view(np.int64)})

    return dealt.groupBy("shard", "part").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the least node of the component. Large-star and small-star by turns, until neither changes an edge. Tasks follow the number of edges."""
    edges = in_fewer(checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), EDGES_A_TASK)
    edges = in_fewer(checkpointed(edges.distinct()), EDGES_A_TASK)
    while True:  # a chain of n edges takes about log(n) rounds
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("at")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small-star: every edge points from larger to smaller; a node hands its smaller neighbours the least of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), "m")
        small = large.join(lowest, F.col("a") == F.col("at")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = in_fewer(checkpointed(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()), EDGES_A_TASK)
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_size: int = SHARD_FINGERPRINTS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that chains of links reach."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(classes.select("fp"), radius, shard_size))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only classes with links share a root; each is the only one otherwise
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    labels = rooted.join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(labels, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
