"""Personal data: fixed expressions, and bootstrapped contextual extraction for what they miss.

The expressions' spans are the seeds. Candidates are runs of one to WIDTH neighbouring identifier-like tokens (with a digit or "@") that no
seed touches. Both are instances, and each has lexical patterns on several levels:

- the two words before; the word before and the word after (each with whether the instance has an "@");
- the word before with the instance's shape; the word after with its shape; its shape alone (runs of letters and digits as one sign each);
- its exact shape (every digit as a sign).

Spark scores the graph of patterns and instances in rounds. A pattern's confidence in a kind is the sum of its instances' scores over
their number plus SMOOTH; seeds score 1. A pattern of confidence CONFIDENT and support SUPPORT is sure: an instance that is no seed scores
the highest confidence of its sure patterns, which lends confidence to its other patterns in the next round. Instances of patterns that are not sure score
nothing, so doubt does not add up. In the end the sure patterns mark their candidates, as kind `context_...`; of marks that overlap in a text
the first stays, of those that begin together the longest.

Seeds and candidates are extracted once, into a checkpoint without texts, with patterns and instances as 64-bit hashes; the graph has an edge for each
distinct pair, and every step is an aggregation that combines on the map side or a join whose small side is repeated SALT times, so that a
pattern (or an instance) with very many edges is spread.

held_back() measures the method: a part of the seeds plays unseen, and what is found of it is counted.

Cases: a null text is empty; texts of any length are read whole in linear time; repeated rows are told apart by a row number and give equal results;
patterns of equal confidence for several kinds take the first; an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, small_batches, span_text, table, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, SMOOTH, CONFIDENT, SUPPORT = 3, 2.0, 0.8, 3.0
WIDTH = 4  # tokens of a candidate
SALT = 16

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run can start a match only at its first digit, for each match ends with its last run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
MARKED = re.compile(r"[0-9@]\S*")
WORD = re.compile(r"\w+")
EDGE = ".,;:!?[]{}<>\"'|`#$%&*"
SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # no later address can use what stands before this sign: it is in no local part
        done = found.end() if found else at + 1
        at = text.find("@", max(at + 1, done if found else 0))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed expressions, by start, then by kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def tokens(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens without the signs around them, those that a base span touches left out."""
    out, done, k = [], 0, 0
    by_end = sorted((e, s) for _, s, e in base)
    reach = [e for e, _ in by_end]  # least start of this and all later ones, for spans of different kinds overlap
    least = len(text) + 1
    for j in range(len(by_end) - 1, -1, -1):
        least = min(least, by_end[j][1])
        reach[j] = least
    for m in MARKED.finditer(text):
        start, end = m.span()
        while start > done and not SPACE.match(text[start - 1]):
            start -= 1
        done = end
        while start < end and text[start] in EDGE:
            start += 1
        while start < end and text[end - 1] in EDGE:
            end -= 1
        while k < len(by_end) and by_end[k][0] <= start:
            k += 1
        if start < end and (k == len(by_end) or reach[k] >= end):
            out.append((start, end))
    return out


def candidates(text: str, base: list[tuple[str, int, int]], width: int = WIDTH) -> list[tuple[int, int]]:
    """Runs of one to `width` tokens with a space between them."""
    found, out = tokens(text, base), []
    for j, (start, end) in enumerate(found):
        out.append((start, end))
        for k in range(j + 1, min(j + width, len(found))):
            if found[k][0] != found[k - 1][1] + 1 or text[found[k][0] - 1] != " ":
                break
            out.append((start, found[k][1]))
    return out


def shapes(instance: str) -> tuple[str, str]:
    """(runs as one sign each, every digit as a sign)."""
    letters = re.sub(r"[^\W\d_]+", "a", instance)
    return re.sub(r"\d+", "0", letters), re.sub(r"\d", "0", letters)


class Surroundings:
    """The two words before and the word after places that come in order of their start, in one pass over the words of a text."""

    def __init__(self, text: str):
        self.text, self.words = text, WORD.finditer(text)
        self.two, self.coming = ["^", "^"], next(self.words, None)
        self.searched, self.after_at = -1, -1  # no word begins between these two places

    def at(self, start: int, end: int) -> tuple[str, str, str]:
        while self.coming and self.coming.end() <= start:
            self.two = [self.two[1], self.coming.group()]
            self.coming = next(self.words, None)
        near = WORD.search(self.text, end, self.searched) if end < self.searched else None
        if not near and self.after_at < max(end, self.searched):
            self.searched, near = end, WORD.search(self.text, end)
            self.after_at = near.start() if near else len(self.text) + 1
        after = WORD.match(self.text, near.start() if near else self.after_at)
        return self.two[0], self.two[1], after.group() if after else "$"


def patterns(before: str, near: str, after: str, instance: str) -> list[str]:
    plain = lambda word: re.sub(r"\d", "0", word.lower())
    a, b, c, sign = plain(before), plain(near), plain(after), "@" if "@" in instance else "0"
    coarse, fine = shapes(instance)
    return [f"1 {a} {b} {sign}", f"2 {b} {c} {sign}", f"3 {b} {coarse}", f"4 {c} {coarse}", f"5 {coarse}", f"6 {fine}"]


SEEN = "array<struct<kind:string,start:long,end:long,instance:long,patterns:array<long>>>"


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, seen): the seeds, with their kind, and the candidates, without one. Checkpointed, so row numbers hold."""
    import xxhash

    def number(s: str) -> int:
        n = xxhash.xxh64_intdigest(s.encode())
        return n - (n >> 63 << 64)

    @F.pandas_udf(SEEN)
    def see(texts: pd.Series) -> pd.Series:
        rows = []
        for text in texts:
            base = base_spans(text)
            spans = sorted([*base, *((None, s, e) for s, e in candidates(text, base))], key=lambda x: (x[1], x[2]))
            near = Surroundings(text) if spans else None
            rows.append([{"kind": k, "start": s, "end": e, "instance": number(text[s:e]), "patterns": [number(p) for p in patterns(*near.at(s, e), text[s:e])]} for k, s, e in spans])
        return pd.Series(rows)

    seen = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), see(text_or_empty(text_col)).alias("seen"))
    return checkpointed(seen)


def _salted(large: DataFrame, small: DataFrame, key: str, spread: Column) -> DataFrame:
    """large joined with small, in which a key comes once, on their key: rows of one key go to SALT tasks."""
    copies = small.withColumnRenamed(key, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return large.join(copies, (F.col(key) == F.col("_key")) & (F.pmod(F.xxhash64(spread), F.lit(SALT)) == F.col("_copy"))).drop("_key", "_copy")


def sure_patterns(seen: DataFrame, rounds: int = ROUNDS, smooth: float = SMOOTH, confident: float = CONFIDENT, support: float = SUPPORT) -> DataFrame:
    """seen (pattern, instance, kind: null unless a seed) -> (pattern, as, confidence) of the patterns that may mark candidates."""
    edges = checkpointed(seen.groupBy("pattern", "instance").agg(F.min("kind").alias("seed")))
    scored = edges.select("pattern", F.col("seed").alias("as"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    for turn in range(rounds):
        sums = scored.groupBy("pattern").agg(F.count("*").alias("size"), *[F.sum(F.when(F.col("as") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS])
        # of equal sums the kind that is listed first
        best = F.greatest(*[F.struct(F.col(k).alias("sum"), F.lit(-j).alias("turn"), F.lit(k).alias("kind")) for j, k in enumerate(KINDS)])
        told = sums.withColumn("best", best).select("pattern", F.col("best.kind").alias("as"), F.col("best.sum").alias("sum"), (F.col("best.sum") / (F.col("size") + F.lit(smooth))).alias("confidence"))
        sure = checkpointed(told.filter((F.col("confidence") >= confident) & (F.col("sum") >= support)).select("pattern", "as", "confidence"))
        if turn == rounds - 1:
            return sure
        open_edges = edges.filter("seed is null").select("pattern", "instance")
        best = F.max(F.struct("confidence", -F.array_position(F.array(*map(F.lit, KINDS)), F.col("as")), "as"))
        found = _salted(open_edges, sure, "pattern", F.col("instance")).groupBy("instance").agg(best.alias("best")).select("instance", F.col("best.as").alias("as"), F.col("best.confidence").alias("score"))
        spread = _salted(open_edges, found, "instance", F.col("pattern")).select("pattern", "as", "score")
        # one row for each edge, with what it scores: seeds, instances found, and (for the sizes) all others
        rest = _salted_anti(open_edges, found)
        scored = edges.filter("seed is not null").select("pattern", F.col("seed").alias("as"), F.lit(1.0).alias("score")).union(spread).union(rest)
    return sure


def _salted_anti(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges of instances that are not found."""
    copies = found.select(F.col("instance").alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_copy"))
    left = edges.join(copies, (F.col("instance") == F.col("_key")) & (F.pmod(F.xxhash64("pattern"), F.lit(SALT)) == F.col("_copy")), "left_anti")
    return left.select("pattern", F.lit(None).cast("string").alias("as"), F.lit(0.0).alias("score"))


def _each(rows: DataFrame) -> DataFrame:
    spans = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    return spans.select("row", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern"))


def _marks(each: DataFrame, **settings) -> DataFrame:
    """(row, start, end, instance, as): the candidates that a sure pattern marks."""
    found = _salted(each.filter("kind is null"), sure_patterns(each, **settings), "pattern", F.struct("row", "start", "end"))
    best = F.max(F.struct("confidence", -F.array_position(F.array(*map(F.lit, KINDS)), F.col("as")), "as"))
    return found.groupBy("row", "start", "end", "instance").agg(best.alias("best")).select("row", "start", "end", "instance", F.col("best.as").alias("as"))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _apart(marks: pd.Series) -> pd.Series:
    """Of marks that overlap the first, and the longest of those that begin together."""
    out = []
    for row in marks:
        kept, done = [], -1
        for m in sorted(row, key=lambda m: (m["start"], -m["end"])):
            if m["start"] >= done:
                kept.append(m)
                done = m["end"]
        out.append(kept)
    return pd.Series(out)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), by start, then as listed; spans also has what the patterns found."""
    rows = extract(docs, id_col, text_col)
    span = F.struct(F.concat(F.lit("context_"), "as").alias("kind"), "start", "end")
    more = _marks(_each(rows), **settings).groupBy("row").agg(F.collect_list(span).alias("more"))  # a document's own spans
    more = more.select(F.col("row").alias("at"), F.pandas_udf(_apart, SPANS)("more").alias("more"))
    base = F.transform(F.filter("seen", lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"context_{k}") for k in KINDS])
    keyed = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    ordered = lambda a: F.transform(F.array_sort(keyed(a)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = rows.join(more, F.col("row") == F.col("at"), "left").select("doc_id", base.alias("base"), "more")
    every = ordered(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    return joined.select("doc_id", ordered(F.col("base")).alias("base"), every.alias("spans"))


def held_back(docs: DataFrame, part: int = 10, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(kind, held, found, marked): every part-th seed instance (by hash) plays unseen. held: how many spans that are; found: those marked
    as their kind (recall is found / held); marked: all candidates and held spans marked as the kind (found / marked is the least precision).
    Held spans count against their patterns, so a part must be small beside 1 - CONFIDENT."""
    each = _each(extract(docs, id_col, text_col))
    away = F.pmod(F.xxhash64("instance"), F.lit(part)) == 0
    truth = each.filter(F.col("kind").isNotNull() & away).select("row", "start", "end", F.col("kind").alias("truth")).distinct()
    marks = _marks(each.withColumn("kind", F.when(~away, F.col("kind"))), **settings)
    both = marks.join(truth, ["row", "start", "end"], "full")
    kinds = both.select(F.explode(F.array_distinct(F.array_compact(F.array("truth", "as")))).alias("kind"), "truth", "as")
    is_ = lambda c: F.count_if(F.col(c) == F.col("kind"))
    return kinds.groupBy("kind").agg(is_("truth").alias("held"), F.count_if((F.col("truth") == F.col("kind")) & (F.col("as") == F.col("kind"))).alias("found"), is_("as").alias("marked"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
