"""Mixing sources to target weights by weighted fair queueing.

Targets: the sources, in code-point order with null last, weigh 5, 2, 1, 5, ... and share all words; a target stops at
PASSES times its source's size, and what is left over is shared among the others by weight until no target is above. This is
the level L at which sum(min(PASSES * size, L * weight)) equals all words; in order of size / weight the sources that stop
come first, so L comes from running sums over the table of sources.

Queueing: each source deals its documents in a shuffled order (by hash), pass after pass, in packets of at most a PACKETS-th part
of the budget. A packet's virtual finish time is the words its source has dealt up to and with it, divided by the source's
target. All packets are sorted by that time and truncated at the total budget, the packet where it falls is cut: what lies before is
the mix. Packets of a source finish in order, so the mix has a beginning of each source's sequence, within a few packets of its target:
at time 1 the sources have dealt their targets, which sum to the budget.

The order is by ranges: time runs evenly in words, so equal steps of it are buckets of about equal work. The sums of the buckets tell in
which one the budget falls; later ones go no further. Running sums, of a source's words and of all packets, come from
bucket sums (common.bucketed_prefix): no window holds a source or the mix.

Cases: a null text has size 0; documents of size 0 are never dealt; a source with no words has target 0; null sources form
one source; the shuffle is by a hash of doc_id and text, so only rows that repeat both stand together; they are dealt one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickweave.llm.common import bucketed_prefix, checkpointed, partitions_for, table, text_or_empty

WEIGHTS = (5, 2, 1)
PASSES = 3
BUCKET_ROWS = 10_000
PACKETS = 100_000  # a packet holds at most this part of the budget
SEED = 7


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return (F.length(squeezed) - F.length(F.translate(squeezed, "w", ""))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sizes (source, source_size), a row for each source -> with target. The windows hold one row a source, not documents."""
    everything, ordered = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place + 1).cast("long")
    ranked = sizes.select("source", "source_size", weight.alias("weight"), F.sum("source_size").over(everything).alias("total"))
    cap = F.col("source_size") * passes
    # sources by cap / weight; `before` sums those that stop below a source
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    summed = ranked.withColumn("cap", cap).select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("stopped"), F.sum("weight").over(onward).alias("open_weight")
    )
    # the level if this source and all after it stay open; the first source below whose cap it lies is the first open one
    left = F.col("total") - F.col("stopped")
    opens = summed.withColumn("fits", left * F.col("weight") <= F.col("cap") * F.col("open_weight"))
    level = F.struct(F.min(F.when(F.col("fits"), F.struct("stopped", "open_weight"))).over(everything)["stopped"].alias("stopped"),
                     F.min(F.when(F.col("fits"), F.struct("stopped", "open_weight"))).over(everything)["open_weight"].alias("open_weight"))
    target = F.when(
        (F.col("total") - F.col("level.stopped")) * F.col("weight") <= F.col("cap") * F.col("level.open_weight"),
        F.col("weight") * (F.col("total") - F.col("level.stopped")) / F.col("level.open_weight"),
    ).otherwise(F.col("cap"))
    return opens.withColumn("level", level).select("source", "source_size", target.cast("double").alias("target"))


def _in_turn(sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Add what its source has dealt before each document in a pass (_before), and source_size and target of its source."""
    # buckets of the hash's range: in order of the hash, so that order and running sum agree
    bucket = F.floor((F.col("_order") / F.lit(float(2**63)) + 1) / 2 * partitions_for(rows, BUCKET_ROWS))
    order = [F.col("_order"), F.col("doc_id"), F.col("_tie")]
    summed = bucketed_prefix(sized.withColumn("_bucket", bucket), ["source"], "_bucket", order, "size", "_before").drop("_bucket")
    return summed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def packets(in_turn: DataFrame, packet: int, passes: int) -> DataFrame:
    """(source, at, words, finish): every packet of every pass; at counts its source's words before it."""
    starts = F.array(*[F.col("_before") + F.col("source_size") * k for k in range(passes)])
    deals = in_turn.filter("size > 0").select("source", "size", "target", F.explode(starts).alias("_start"))
    each = deals.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))).alias("_from"))
    at, words = F.col("_start") + F.col("_from"), F.least(F.lit(packet).cast("long"), F.col("size") - F.col("_from"))
    return each.select("source", at.alias("at"), words.alias("words"), ((at + words).cast("double") / F.col("target")).alias("finish"))


def truncated(each: DataFrame, budget: int, buckets: int) -> DataFrame:
    """packets -> those in the mix, with take: their words up to the budget, in order of finish time over all sources; ties to the source that comes first."""
    each = each.withColumn("_bucket", F.floor(F.col("finish") * buckets))
    so_far = F.sum("n").over(W.orderBy("_bucket"))  # a row a bucket
    sums = each.groupBy("_bucket").agg(F.sum("words").alias("n")).withColumn("so_far", so_far)
    last = sums.filter(F.col("so_far") >= budget).agg(F.min("_bucket")).first()[0]
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("at")]
    running = bucketed_prefix(each.filter(F.col("_bucket") <= F.lit(last)), [], "_bucket", order, "words", "_ahead")
    take = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("_ahead"))).cast("long")
    return running.withColumn("take", take).filter("take > 0").drop("_bucket", "_ahead")


def deal(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, seed: int = SEED, size: Column | None = None, parts: int = PACKETS
) -> DataFrame:
    """docs (doc_id, text, source, ...) -> all columns and size, source_size, target, dealt.

    dealt: an array of (pass, finish, take): the virtual finish time of each deal that is in the mix and the words it takes. The sort and the
    truncation work on rows without texts; they tell how many words of each source are in.
    """
    text = text_or_empty("text")
    sized = docs.drop("source_size", "target", "dealt").withColumns({"size": word_count(text) if size is None else size, "_tie": F.xxhash64(text)})
    sized = sized.withColumn("_order", F.xxhash64(F.col("doc_id"), F.col("_tie"), F.lit(seed)))
    narrow = checkpointed(sized.select("source", "doc_id", "size", "_order", "_tie"))
    sizes = checkpointed(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))  # a row a source
    rows, budget = (x or 0 for x in sizes.agg(F.sum("n"), F.sum("source_size")).first())
    targets = checkpointed(source_targets(sizes.select("source", "source_size"), weights, passes))
    in_turn = checkpointed(_in_turn(narrow, targets, rows).select("source", "size", "source_size", "target", "_before"))
    each = packets(in_turn, max(1, math.ceil(budget / parts)), passes)
    mixed = truncated(each, budget, partitions_for(rows + parts, BUCKET_ROWS))
    words = mixed.groupBy("source").agg(F.sum("take").alias("_words")).withColumnRenamed("source", "_of")
    told = checkpointed(targets.join(words, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of"))  # a row a source

    def one(k: int) -> Column:
        start = F.col("_before") + F.col("source_size") * k
        take = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("_words", F.lit(0)) - start)).cast("long")
        finish = F.try_divide((start + F.col("size")).cast("double"), F.col("target"))
        return F.struct(F.lit(k).alias("pass"), finish.alias("finish"), take.alias("take"))

    dealt = F.filter(F.array(*[one(k) for k in range(passes)]), lambda d: d["take"] > 0)
    return _in_turn(sized, told, rows).withColumn("dealt", dealt).drop("_order", "_tie", "_before", "_words")


def mix(dealt: DataFrame) -> DataFrame:
    """The mix in order: a row for each deal, with pass, finish and take; a global range sort by virtual finish time."""
    each = dealt.select("*", F.explode("dealt").alias("_deal")).drop("dealt")
    return each.select(*[c for c in each.columns if c != "_deal"], "_deal.pass", "_deal.finish", "_deal.take").orderBy("finish", "source", "doc_id", "pass")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; null stays null."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        done = []
        for t, k in zip(texts, counts):
            end = 0
            for _, m in zip(range(int(k)), word.finditer(t or "")):
                end = m.end()
            done.append(None if t is None else t[:end])
        return pd.Series(done, dtype=object)

    return cut(text, n)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # texts are read for their sizes and go no further
    narrow = checkpointed(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), F.xxhash64("text").cast("string").alias("text")))
    taken = F.aggregate("dealt", F.lit(0).cast("long"), lambda a, d: a + d["take"])
    return deal(narrow, size=F.col("size")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
