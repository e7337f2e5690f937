"""Best-fit packing of token sequences under several capacities.

Tokenizing: each document's ids and an end id; longer ones than a sequence are cut, the short piece first. Each piece is a vector:
its tokens, one piece, and its attention cost (tokens squared). By default a sequence may hold as many pieces and as much attention as its
tokens allow (the query wants as few sequences as can be), so tokens bind alone; pack() takes tighter capacities.

Vector best-fit: pieces in order of falling length; each goes to the open sequence that it fits into under every
capacity and whose residual, after it, is best: least weighted norm (`norm`), or largest weighted dot product of piece and
residual (`dot`). Which sequence a piece gets depends on its length alone, so the choice is made
once for each length and kind of sequence, with multiplicities, on the counts by length: at most one row for each
length, however many documents there are. The resulting plan says for each length which run of ranks goes to which
sequences; pieces get their rank among those of their length (common.bucketed_prefix: no window holds a length) and look their place up.

Cases: a null text is empty and gives one piece with the end id alone; repeated rows are packed one by one; texts of any length
are read whole; an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import bucketed_prefix, byte_runs, checkpointed, partitions_for, small_batches, table, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary
END_ID = 2
TOKENS = 1024
BUCKET_ROWS = 40_000
WEIGHTS = (1.0, 0.01, 0.01)
AT_ONCE = 2_000_000  # bytes of text encoded at once, one text at least
LONG_WORD = 1000  # bytes from which a word goes to the tokenizer alone
#: White space as the tokenizer's pattern has it, and the separators \x1C to \x1F, which only make the tests below stricter.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space around a space (or before one that ends the text): there the pattern does not begin a new part at the space.
JOINED = rf"{WHITE}\x20(?:{WHITE}|\z)"


@cache
def encoder(name: str, ranks: str) -> Encoder:
    """One for each worker process."""
    return Encoder(name, ranks)


class Encoder:
    """ids as the tokenizer gives them, for a batch of texts at once.

    The tokenizer's pattern begins a new part at every space, but where there is white space on both sides of it (JOINED), and merges only
    within parts. So a text's ids are those of its words (what lies between spaces), each with the space before it. The distinct words of a
    batch are encoded in one go, by the same vocabulary's ranks, and gathered by array operations. Texts with joined spaces or special tokens, and
    very long words, go to the tokenizer itself.
    """

    def __init__(self, name: str = TOKENIZER, ranks: str = RANKS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks)) as lines:
            table_ = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
        self.by_ranks = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        self.opens = np.zeros(max(table_.values()) + 1, bool)  # tokens that begin with a space: only the first one of a word
        self.opens[[rank for token, rank in table_.items() if token[:1] == b" "]] = True

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, each with a space before it, where a word begins, how many it has)."""
        # a word that begins with white space could join with the space before it and what ends the word before
        apart = pc.or_(pc.match_substring_regex(words, rf"\A(?:{WHITE}|\z)"), pc.greater(pc.binary_length(words), LONG_WORD)).to_numpy(zero_copy_only=False)
        rest = words.filter(pa.array(~apart))
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), " ")[0].as_py()
        ids = np.array(self.by_ranks.encode_ordinary(f" {line}") if len(rest) else [], np.uint32)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.flatnonzero(self.opens[ids])
        begin[~apart], size[~apart] = at, np.diff(np.append(at, len(ids)))
        odd = self._alone([f" {w}" for w in words.filter(pa.array(apart)).to_pylist()])
        size[apart] = [len(x) for x in odd]
        begin[apart] = len(ids) + np.cumsum(size[apart]) - size[apart]
        return np.concatenate([ids, *odd]), begin, size

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not len(texts):
            return []
        whole = pc.match_substring_regex(texts, JOINED)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        unique = split.flatten().dictionary_encode()
        number, first = unique.indices.to_numpy(), (offsets - offsets[0])[:-1]
        pool, begin, size = self._words(unique.dictionary)
        begin, size = begin[number], size[number]
        # the first words have no space before them
        openings, place = np.unique(number[first], return_inverse=True)
        opening = unique.dictionary.take(pa.array(openings)).to_pylist()
        short = [len(w) <= LONG_WORD for w in opening]
        long_ones = iter(self._alone([w for w, s in zip(opening, short) if not s]))
        own = [np.array(self.by_ranks.encode_ordinary(w), np.uint32) if s else next(long_ones) for w, s in zip(opening, short)]
        lengths = np.array([len(x) for x in own], np.int64)
        begin[first], size[first] = (len(pool) + np.cumsum(lengths) - lengths)[place], lengths[place]
        pool = np.concatenate([pool, *own])
        ends = np.cumsum(size)
        flat = pool[np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)]
        bound = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
        out = [flat[a:b] for a, b in zip(bound, bound[1:])]
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for k, ids in zip(at, self._alone([texts[k].as_py() for k in at])):
            out[k] = ids
        return out


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str = RANKS, end_id: int = END_ID, tokens: int = TOKENS, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a row for each piece; ids as little-endian unsigned 32-bit numbers. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer, ranks).ids, np.array([end_id], "<u4")
        for batch in batches:
            row, piece, start, length, crc, ids_out = [], [], [], [], [], []
            texts = batch.column(1)
            runs = byte_runs(pc.binary_length(texts).to_pylist(), AT_ONCE)
            for k, text_ids in enumerate(ids for run in runs for ids in ids_of(texts.slice(run.start, len(run)))):
                ids = np.concatenate([text_ids, end]).astype("<u4", copy=False)
                first = (len(ids) - 1) % tokens + 1
                bounds = [0, *range(first, len(ids) + 1, tokens)]
                for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    raw = ids[a:b].tobytes()
                    row.append(k), piece.append(j), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw))
                    if with_ids:
                        ids_out.append(raw)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return small_batches(docs).select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(cut, out)


def vector_best_fit(
    counts: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, score: str = "norm"
) -> list[tuple[int, list[int]]]:
    """counts: pieces by length -> kinds of sequence, (how many, the lengths in each). Every kind is within all capacities."""
    cap = np.array(capacities, np.int64)
    scale = np.array(weights) / cap.astype(float) ** 2
    residual, many, items = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), []  # items: chains (length, how often, what came before)

    def add(count: int, left: np.ndarray, chain_: tuple) -> None:
        nonlocal residual, many
        residual, many = np.vstack([residual, left]), np.append(many, count)
        items.append(chain_)

    for length in sorted(counts, reverse=True):
        vector, left = np.array([length, 1, length * length], np.int64), counts[length]
        if (vector > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = np.flatnonzero((many > 0) & (residual >= vector).all(1))
            if len(fits):
                after = residual[fits] - vector
                rank = (after.astype(float) ** 2 @ scale) if score == "norm" else -(residual[fits].astype(float) @ (scale * vector))
                best = int(fits[np.argmin(rank)])
                room, count, before = residual[best].copy(), int(many[best]), items[best]
            else:
                best, room, count, before = -1, cap, left, ()
            each = int((room // vector).min())
            bins = min(count, left // each)
            if not bins:
                bins, each = 1, left  # the last ones share a sequence
            add(bins, room - each * vector, (length, each, before))
            left -= bins * each
            if best >= 0:
                many[best] -= bins
        if len(many) > 4096:  # forget what is used up
            keep = np.flatnonzero(many > 0)
            residual, many, items = residual[keep], many[keep], [items[k] for k in keep]
    kinds = []
    for count, link in zip(many.tolist(), items):
        if count:
            lengths: list[int] = []
            while link:
                lengths += [link[0]] * link[1]
                link = link[2]
            kinds.append((count, lengths[::-1]))
    return kinds


def pack(
    pieces: DataFrame, capacities: tuple[int, int, int] = (TOKENS, TOKENS, TOKENS * TOKENS), weights: tuple[float, float, float] = WEIGHTS, score: str = "norm"
) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...). capacities: tokens, pieces and attention cost of a sequence.

    pieces are read twice, so give a checkpointed table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    keys, sequences, offsets, used, base = [], [], [], dict.fromkeys(counts, 0), 0
    for count, lengths in vector_best_fit(counts, capacities, weights, score):
        at = 0
        for n in lengths:  # ranks used[n] .. used[n] + count go to the sequences of this kind, one each
            keys.append((n << 40) + used[n])
            sequences.append(base)
            offsets.append(at)
            used[n] += count
            at += n
        base += count
    order = np.argsort(np.array(keys, np.int64))
    keys, sequences, offsets = (np.array(x, np.int64)[order] for x in (keys, sequences, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        at = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + key - keys[at], "offset": offsets[at]})

    buckets = partitions_for(sum(counts.values()), BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    ranked = bucketed_prefix(pieces.withColumn("_bucket", bucket), ["length"], "_bucket", [F.col("doc_id"), F.col("piece")], None, "_rank")
    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack(checkpointed(token_pieces(docs)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
