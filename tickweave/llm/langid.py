"""Language ID by word-first backoff.

A known word (seen often enough in training) scores each language by the log frequency of the word there; a word that is
not known is scored by its character n-grams, longest first: at each place the longest known n-gram that starts there
counts, so unseen words fall back to shorter and shorter n-grams.

Training: word counts by language from a bounded sample of the labelled rows: SAMPLE_ROWS, shared equally among the languages, by hash of id and
text, so that it does not depend on the layout and a rare language has its share. Every language, word and n-gram of the sample is learnt
(words and grams can bound the model further), so the model, which every task gets, is as large as the sample's vocabulary. Prediction reads whole
texts of all documents.

Words are runs of letters, lower-cased. Score: the probability of the language predicted, from the mean log score of a word
sharpened as if the text had at most EVIDENCE words (long texts would otherwise always score 1).

Cases: null texts and texts without letters give `und` with score 0; without any training row all others do too; ties go to
the language that comes first; a null id is never held out and never trained on; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickweave.llm.common import checkpointed, small_batches, table, text_or_empty

SAMPLE_ROWS = 8_000
ORDERS = (4, 3, 2, 1)
LEAST_WORD_COUNT = 3  # a word seen less often is unseen
EVIDENCE = 12
KEPT_SCORES = 240_000  # scores of unseen words that a worker remembers
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # row of `table`
    grams: dict[int, dict[str, int]]
    table: np.ndarray  # log frequencies, a column for each language

    def word_scores(self, word: str) -> np.ndarray:
        """An unseen word: at each place the longest n-gram known."""
        marked, rows = f"^{word}$", []
        for at in range(len(marked)):
            for order in ORDERS:
                row = self.grams[order].get(marked[at : at + order]) if at + order <= len(marked) else None
                if row is not None:
                    rows.append(row)
                    break
        return self.table[rows].mean(0) if rows else np.zeros(len(self.languages), np.float32)


class Predictor:
    """A memory of the scores of unseen words. It doesn't hold the model, which holds it: so both go as soon as a worker drops the model."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.index: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((KEPT_SCORES // max(1, len(model.languages)), len(model.languages)), np.float32)

    def predict(self, model: Model, text: str) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower()))
        # a run may be of numerals alone, like superscripts: a text needs a letter
        if not self.languages or not any(c.isalpha() for w in counts for c in w):
            return UNKNOWN, 0.0
        words, get = list(counts), model.words.get
        rows = np.array([get(w, -1) for w in words])
        scores = np.zeros((len(rows), len(self.languages)), np.float32)
        scores[rows >= 0] = model.table[rows[rows >= 0]]
        for k in np.flatnonzero(rows < 0).tolist():
            at = self.index.get(words[k])
            if at is not None:
                scores[k] = self.table[at]
                continue
            scores[k] = model.word_scores(words[k])
            if self.used < len(self.table):
                self.table[self.used] = scores[k]
                self.index[words[k]] = self.used
                self.used += 1
        often = np.fromiter(counts.values(), np.float64, len(counts))
        n = often.sum()
        level = often @ scores / n * min(n, EVIDENCE)
        odds = np.exp(level - level.max())
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best] / odds.sum())


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, words: int | None = None, grams: int | None = None
) -> Model:
    """Learn from the rows with a language; the rows given are those that may be learnt from. words, grams: how many of each language (and
    order) are kept, the most frequent; all by default."""
    rows = small_batches(docs).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return _model([], pd.DataFrame({"lang": [], "order": [], "word": [], "n": []}))
    chance = {lang: min(1.0, sample_rows / len(languages) / n) for lang, n in sizes.items()}
    below = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(int((2 * chance[lang] - 1) * 2**63), 2**63 - 1))])
    if min(chance.values()) < 1.0:
        rows = rows.filter(F.xxhash64("id", "text", F.lit(5)) <= below[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # counts of a batch leave the task already summed
        for batch in batches:
            found: dict = defaultdict(Counter)
            for text, lang in zip(batch["text"], batch["lang"]):
                found[lang].update(LETTERS.findall(text.lower()))
            yield pd.DataFrame([(l, w, c) for l, ws in found.items() for w, c in ws.items()], columns=["lang", "word", "n"])

    counted = rows.mapInPandas(count, "lang string, word string, n long")
    counted = checkpointed(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                marked = f"^{word}$"
                for order in ORDERS:
                    for at in range(len(marked) - order + 1):
                        found[lang, order, marked[at : at + order]] += n
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "order", "word", "n"])

    parts = counted.mapInPandas(grams_of, "lang string, order int, word string, n long").groupBy("lang", "order", "word").agg(F.sum("n").alias("n"))
    known = counted.filter(F.col("n") >= LEAST_WORD_COUNT).select("lang", F.lit(0).alias("order"), "word", "n")
    kept = known.union(parts)
    if words is not None or grams is not None:
        each = W.partitionBy("lang", "order").orderBy(F.desc("n"), "word")
        most = F.when(F.col("order") == 0, F.lit(words)).otherwise(F.lit(grams))
        kept = kept.withColumn("rank", F.row_number().over(each)).filter(most.isNull() | (F.col("rank") <= most)).drop("rank")
    return _model(languages, kept.toArrow().to_pandas())  # the sample's vocabulary


def _model(languages: list[str], counts: pd.DataFrame) -> Model:
    """counts (lang, order: 0 for words, word, n) -> log frequencies, smoothed by half a count; each order is normed for itself."""
    index: dict[int, dict[str, int]] = {}
    tables, at = [np.zeros((0, len(languages)), np.float32)], 0
    for order in (0, *ORDERS):
        own = counts[counts["order"] == order].sort_values(["word", "lang"])
        place, found = pd.factorize(own["word"])
        n = np.zeros((len(found), len(languages)))
        n[place, np.searchsorted(np.array(languages, object), own["lang"].to_numpy(object))] = own["n"]
        tables.append(np.log((n + 0.5) / (n + 0.5).sum(0)).astype(np.float32))
        index[order] = dict(zip(found.tolist(), range(at, at + len(found))))
        at += len(found)
    return Model(languages, index[0], {o: index[o] for o in ORDERS}, np.vstack(tables))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score. The model goes to each executor once. No shuffle."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model_here = shared.value
        if not hasattr(model_here, "predictor"):  # a worker's copy keeps its memory of words from task to task
            model_here.predictor = Predictor(model_here)
        own = model_here.predictor
        for texts in batches:
            yield pd.DataFrame([own.predict(model_here, t) for t in texts], columns=["lang_pred", "score"])

    # declared nondeterministic so that no plan has it twice, for a filter and for its result
    return docs.withColumn("_judged", judge.asNondeterministic()(text_or_empty(text_col))).select(
        *[c for c in docs.columns if c not in ("lang_pred", "score")], "_judged.lang_pred", "_judged.score"
    )


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
