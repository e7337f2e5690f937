"""Documents of similar wording: all pairs whose sets of word shingles have a Jaccard similarity of 0.8 or more, by prefixes.

Sets: words as in simhash.py; the distinct XXH64 values of all runs of `shingle` words. Texts with fewer words are one shingle; without
words the set is empty, and such texts are one class. Repeats don't count.

Candidates: under one order of all shingles, two sets of similarity s or more share one of the first n - ceil(s n) + 1 shingles of each.
This holds for any order; here shingles that are frequent in a bounded sample come last, so that few sets meet by a common passage.

Parity sketches: of each set the parities of SKETCH counts, how many of its shingles have a hash of that remainder. Two sketches differ in no more places than their sets do,
and sets of similarity s or more differ in at most (1 - s) / (1 + s) of their sizes' sum, so a pair whose sketches differ in more is none: this is exact, is weighed
inside the join, and leaves few pairs of a family whose texts are only partly alike. Each shingle of a prefix also looks at the few before it (BEFORE): two sets that share
one of these meet there already, so a pair of close copies is made about once and not once for each shingle they share.

Links: operator 10 comes first. Fingerprints over the same shingles go through its vantage-point trees, and each class is compared with one of those that
the trees put with it, so families of close copies are one component before any join. Fingerprints tell neither all similar pairs nor only those, so a link
of the trees counts if the sets bear it out, and pairs that can be similar by prefixes and sketches and that the trees leave apart are compared exactly too:
where they are very many first each with one pivot of the shingle's sets, so that comparisons stay in proportion to a group's size; then all that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, in_fewer, small_batches, text_or_empty
from tickweave.llm.simhash import RADIUS, SEED, components, digests, majority, near_pairs

SHINGLE = 5
PERCENT = 80  # least similarity
SAMPLE = 10_000  # sets in the sample for the order, about
SAMPLE_TASKS = 6
FREQUENT = 100_000  # shingles with a place of their own in the order, at most
FEW = 500_000  # ids that are sent to all executors
PIVOT_ROUNDS = 1
SKETCH, FINE = 512, 4096  # parities of a set, for the join and before sets are compared
BEFORE = 4  # shingles that one of a prefix knows of those before it
PAIRS_A_TASK = 100_000
PAIRS_A_ROW = 32  # pairs to compare for each (shingle, set), from which another round of pivots is cheaper


def shingle_set(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    runs = list(digests(text, shingle, seed))
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Both sorted and distinct."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix(values: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set in the order (count in the sample, value); `frequent` is sorted, all others have a count of 0."""
    n = len(values)
    first = n + percent * n // -100 + 1 if n else 0
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        level = np.where(frequent[at] == values, counts[at], 0)
        if level.any():
            return values[np.lexsort((values, level))[:first]]
    return values[:first]


def _order(docs: DataFrame, shingle: int, sample_size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that are frequent in a sample, at most `most` of them. What is left out changes the order, not the links."""
    chance = min(1.0, sample_size / max(docs.count(), 1))
    sample = docs if chance == 1.0 else docs.filter(F.rand(SEED) < chance)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [shingle_set(t, shingle) for batch in batches for t in batch["text"]]
        if found:
            s, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"s": s[n > 1].view(np.int64), "n": n[n > 1]})

    counts = small_batches(sample.select("text")).repartition(SAMPLE_TASKS).mapInPandas(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = counts.filter("n > 2").orderBy(F.desc("n"), "s").limit(most).toPandas()
    s, n = rows["s"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    by = np.argsort(s)
    return s[by], n[by]


def parities(values: np.ndarray, places: int = SKETCH) -> np.ndarray:
    """A set's sketch, 64 parities to a long."""
    odd = np.bincount((values % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(one: str, other: str, places: int = SKETCH) -> Column:
    """In how many places two sketches (columns) differ."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.get(one, k).bitwiseXOR(F.get(other, k))) for k in range(places // 64)))


def _class_of(values: np.ndarray) -> int:
    """Equal sets, equal class: the hash of a set's bytes as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), SEED)).view(np.int64))


def _prints(docs: DataFrame, shingle: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, fp, n, print, prefix, sketch): class, size, fingerprint (of operator 10, from the same shingles), first shingles and parities of each document's set."""

    @F.pandas_udf("fp long, n int, print long, prefix array<long>, sketch array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found, prints = [], []
        for t in texts:
            runs = list(digests(t, shingle))
            found.append(np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64))
            prints.append(majority(runs))
        first = [prefix(s, *order, percent).view(np.int64) for s in found]
        sketch = pd.Series([parities(s) for s in found], dtype=object)
        return pd.DataFrame({"fp": np.array([_class_of(s) for s in found], np.int64), "n": np.array([len(s) for s in found], np.int32), "print": np.array(prints, np.uint64).view(np.int64), "prefix": pd.Series(first, dtype=object), "sketch": sketch})

    return checkpointed(small_batches(docs).select("doc_id", of("text").alias("of")).select("doc_id", "of.*"))


def _of_classes(docs: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """(fp, n, body) of the classes in pairs (a, b), made anew from the text of the document of least doc_id, or else from those without one: whole sets, or finer sketches of them."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch["text"]]
            body = pd.Series([(s if whole else parities(s, FINE)).tobytes() for s in found], dtype=object)
            yield pd.DataFrame({"fp": np.array([_class_of(s) for s in found], np.int64), "n": np.array([len(s) for s in found], np.int64), "body": body})

    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    needed = F.broadcast(needed) if pairs.count() <= FEW // 2 else needed
    classes = checkpointed(prints.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("least")))
    ids = classes.select(F.col("least").alias("doc_id")).filter("doc_id is not null")
    named = docs.join(F.broadcast(ids) if classes.count() <= FEW else ids, "doc_id", "left_semi")
    nameless = docs.filter("doc_id is null").select("doc_id", "text")
    made = small_batches(named.select("doc_id", "text").union(nameless).select("text")).mapInPandas(of, "fp long, n long, body binary")
    return checkpointed(made.join(classes.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("body").alias("body")))


def _verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, written already, those that are similar: by their finer sketches, then by their sets, which only pairs that are left need."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("boolean")
    def sketched(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        far = np.array([int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) for x, y in zip(a, b)], np.int64)
        return pd.Series(far * (100 + percent) <= (n.to_numpy() + m.to_numpy()) * (100 - percent), dtype=bool)

    def with_bodies(pairs: DataFrame, whole: bool) -> DataFrame:
        bodies = _of_classes(docs, prints, pairs, shingle, whole)
        for c in "ab":
            pairs = pairs.join(bodies.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("body").alias(f"body_{c}")), c)
        return small_batches(pairs)

    left = in_fewer(checkpointed(with_bodies(pairs, False).filter(sketched("body_a", "body_b", "n_a", "n_b")).select("a", "b")), PAIRS_A_TASK)
    return with_bodies(left, True).filter(alike("body_a", "body_b")).select("a", "b")


def tree_links(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(a, b): similar classes by operator 10. Its trees link the fingerprints; each class is compared exactly with the one of its component that has the least number."""
    firsts = checkpointed(prints.groupBy("print").agg(F.min("fp").alias("first")))
    roots = components(near_pairs(firsts.select(F.col("print").alias("fp")), radius))
    rooted = firsts.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("b"))
    pivots = rooted.join(least, F.col("root") == F.col("of")).select(F.col("print").alias("at"), "b")
    classes = prints.groupBy("fp").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.first("sketch").alias("sketch"))
    pairs = checkpointed(classes.join(pivots, F.col("print") == F.col("at")).filter("fp <> b").select(F.col("fp").alias("a"), "n", F.col("sketch").alias("x"), "b"))
    with_pivot = in_fewer(pairs, PAIRS_A_TASK).join(classes.select(F.col("fp").alias("of"), F.col("n").alias("m"), F.col("sketch").alias("y")), F.col("b") == F.col("of"))
    can_be = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (apart("x", "y") * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))
    return _verified(docs, prints, in_fewer(checkpointed(with_pivot.filter(can_be).select("a", "b")), PAIRS_A_TASK), shingle, percent)


def similar_pairs(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(node, root) of the components of all pairs of classes that are similar."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, own = np.unique(batch["fp"].to_numpy(), return_index=True)
            found = batch["prefix"].take(pa.array(own))
            sizes = np.diff(found.offsets.to_numpy())
            if len(flat := found.flatten()):
                yield pa.RecordBatch.from_arrays([flat, pa.array(np.repeat(fp, sizes)), pa.array(np.repeat(batch["n"].to_numpy()[own], sizes))], ["s", "fp", "n"])

    # one exchange by shingle serves the distinct rows and the counts
    rows = prints.select("fp", "n", "prefix").mapInArrow(emit, "s long, fp long, n int").repartition("s").dropDuplicates(["s", "fp"])
    meets = checkpointed(rows.withColumn("k", F.count("*").over(W.partitionBy("s"))).filter("k > 1"))

    drawn = prints.groupBy(F.col("fp").alias("drawn")).agg(F.first("sketch").alias("sketch"), F.first("prefix").alias("of_prefix"))

    def few(one: str, other: str) -> Column:
        return apart(one, other) * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)

    def with_sketch(df: DataFrame, fp: str, name: str) -> DataFrame:
        return df.join(drawn.select("drawn", F.col("sketch").alias(name)), F.col(fp) == F.col("drawn")).drop("drawn")

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(docs, prints, pairs, shingle, percent)

    def joined_with(edges: DataFrame | None, found: DataFrame) -> DataFrame:
        return in_fewer(checkpointed(found if edges is None else edges.union(found)), PAIRS_A_TASK)

    def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        for c in "ab":
            own = roots.select(F.col("node").alias("_node"), F.col("root").alias(f"_of_{c}"))
            pairs = pairs.join(own, F.col(c) == F.col("_node"), "left").drop("_node")
        return pairs.filter(F.coalesce("_of_a", "a") != F.coalesce("_of_b", "b")).select("a", "b")

    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    edges = joined_with(None, tree_links(docs, prints, shingle, percent))
    roots = None if edges.isEmpty() else components(edges)
    for k in range(pivot_rounds + 1):
        if roots is None:
            now = meets.withColumn("root", F.col("fp"))
        else:
            whole = W.partitionBy("s")
            now = meets.join(roots.withColumnRenamed("root", "_root"), F.col("fp") == F.col("node"), "left").select("s", "fp", "n", F.coalesce("_root", "fp").alias("root"))
            now = now.withColumns({"lo": F.min("root").over(whole), "hi": F.max("root").over(whole), "k": F.count("*").over(whole)}).filter("lo < hi").drop("lo", "hi")
            now = checkpointed(now)
        seen = now.agg(F.count("*").alias("rows"), F.sum("k").alias("pairs")).first()
        if not seen["rows"]:
            break
        last = k == pivot_rounds or seen["pairs"] <= PAIRS_A_ROW * seen["rows"]
        if last:
            place = F.array_position("of_prefix", F.col("s")).cast("int") - 1  # what stands before s in its set's prefix
            before = {f"before{i}": F.when(place > i, F.get("of_prefix", place - 1 - i)) for i in range(BEFORE)}
            parts = {f"sketch{i}": F.get("sketch", i) for i in range(SKETCH // 64)}
            rows_now = now.select("s", "fp", "n", "root").join(drawn, F.col("fp") == F.col("drawn")).select("s", "fp", "n", "root", *[v.alias(c) for c, v in (before | parts).items()])
            c = lambda name: (F.col(f"one.{name}"), F.col(f"other.{name}"))
            (s, t), (fp, b), (n, m), (root, of) = map(c, ("s", "fp", "n", "root"))
            far = reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseXOR(y)) for x, y in map(c, parts)))
            close = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (far * (100 + percent) <= (n + m) * (100 - percent))
            met = reduce(lambda x, y: x | y, (F.col(f"one.{i}") == F.col(f"other.{j}") for i in before for j in before))
            # both sides are one exchange
            pairs = rows_now.alias("one").join(rows_now.alias("other"), (s == t) & (fp < b) & (root != of) & ~F.coalesce(met, F.lit(False)) & close)
            pairs = pairs.select(s.alias("s"), fp.alias("fp"), n.alias("n"), root.alias("root"), b.alias("b"), m.alias("m"), of.alias("of"), far.alias("far"))
        else:
            pivot = F.min_by(F.struct(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("root").alias("of")), F.xxhash64("fp", F.lit(k))).over(W.partitionBy("s"))
            pairs = now.withColumn("pivot", pivot).select("s", "fp", "n", "root", "pivot.*", F.lit(0).alias("far"))
        pairs = pairs.filter((F.col("root") != F.col("of")) & near)
        this, that = F.struct("fp", "n"), F.struct(F.col("b").alias("fp"), F.col("m").alias("n"))
        one, other = F.least(this, that), F.greatest(this, that)
        pairs = pairs.select(one.alias("one"), other.alias("other"), "far").select(F.col("one.fp").alias("a"), F.col("one.n").alias("n"), F.col("other.fp").alias("b"), F.col("other.n").alias("m"), "far").distinct()
        if not last:
            pairs = with_sketch(with_sketch(pairs, "a", "x"), "b", "y").filter(few("x", "y"))
        pairs = in_fewer(checkpointed(pairs.select("a", "b", "far")), PAIRS_A_TASK)
        if last:
            # each set's nearest by the sketches first: most of the links then lie within a component
            nearest = pairs.select("a", "b", "far").union(pairs.select("b", "a", "far")).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
            first = checkpointed(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            edges = joined_with(edges, verified(first))
            pairs = in_fewer(checkpointed(across(pairs, components(edges))), PAIRS_A_TASK)
        edges = joined_with(edges, verified(pairs.select("a", "b")))
        roots = components(edges)
        if last:
            break
    return roots if roots is not None else meets.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, sample_size: int = SAMPLE, frequent: int = FREQUENT, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id that chains of similar pairs reach."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    prints = _prints(docs, shingle, percent, _order(docs, shingle, sample_size, frequent))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = similar_pairs(docs, prints, shingle, percent, pivot_rounds)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    labels = rooted.join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.select("doc_id", "fp").join(labels, F.col("fp") == F.col("_fp")).select("doc_id", "component_id")
