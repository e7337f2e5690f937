"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a text.

Statistics are counts that built-in functions take from the whole text; what enters the model are log odds of shares and logs of rates, drawn to the corpus's medians
as if the text had a few words more of the usual kind, so that a text too short to tell is an ordinary one. Means and covariances of each class are aggregations over all labelled rows, centred before they are multiplied. A class covariance is drawn to the classes'
common one (POOLED), then to a multiple of the identity, as far as the oracle approximating shrinkage says for its number of rows. Its Cholesky factor
is taken and inverted once, in the driver; a row's score is a sum of squares for each class with these numbers as literals: the log densities' difference, as a probability.

Everything is DataFrame functions: one pass over the texts, whose statistics are written to the shared folder and serve both learning and scoring; no exchange of texts.

The log densities of a dozen dependent statistics overstate what a text tells, so the difference is divided by TEMPERATURE before it becomes a probability.

Cases: a null text is an empty one, and empty texts have a score like others; a null id is never held out and never learnt from; labels that are null or neither 0 nor 1 don't count, each other
row of labels counts for its documents; documents that repeat an id count one by one; with labels of one class alone the score is that class, without any it is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, table, text_or_empty

POOLED = 0.3  # share of the common covariance in each class's
TEMPERATURE = 4.0
THRESHOLD = 0.3


# ---- statistics


def _left(text: Column, other: str) -> Column:
    """Characters that are left without `other`."""
    return F.length(F.regexp_replace(text, other, "")).cast("double")


def counts_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with counts of the text's parts (columns c_...), in two steps: words once, then what is counted of them."""
    text = text_or_empty(text_col)
    words = F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != "")
    first = docs.withColumns({
        "c_chars": F.length(text).cast("double"),
        "c_letters": _left(text, r"\P{L}+"),
        "c_upper": _left(text, r"\P{Lu}+"),
        "c_digits": _left(text, "[^0-9]+"),
        "c_spaces": _left(text, r"[^ \t-\r]+"),
        "c_lines": _left(text, r"[^\n]+") + 1,
        "c_ends": _left(text, "[^.!?]+"),
        "_words": words,
    })
    many = lambda test: F.size(F.filter("_words", test)).cast("double")
    again = F.zip_with(F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), "_words", lambda a, b: a == b)
    return first.withColumns({
        "c_words": F.size("_words").cast("double"),
        "c_distinct": F.size(F.array_distinct("_words")).cast("double"),
        "c_again": F.size(F.filter(again, lambda x: x)).cast("double"),
        "c_bare": many(lambda w: ~w.rlike(r"[\p{L}0-9]")),
        "c_ragged": many(lambda w: w.rlike(r"[^\p{L}0-9]{2}$")),
        "c_long": many(lambda w: F.length(w) > 12),
        "c_short": many(lambda w: F.length(w) <= 3),
    }).drop("_words")


@dataclass(frozen=True)
class Feature:
    """part of whole (a share), or so much for each of whole (a rate); weight: how much of the whole the corpus's median counts for."""

    part: Column
    whole: Column
    share: bool
    weight: float


def features() -> dict[str, Feature]:
    c = lambda name: F.col(f"c_{name}")
    symbols = F.greatest(c("chars") - c("letters") - c("digits") - c("spaces"), F.lit(0.0))
    shown = c("chars") - c("spaces")
    return {
        "upper": Feature(c("upper"), c("letters"), True, 40),
        "symbols": Feature(symbols, shown, True, 40),
        "digits": Feature(c("digits"), shown, True, 40),
        "again": Feature(c("again"), c("words"), True, 8),
        "bare": Feature(c("bare"), c("words"), True, 8),
        "ragged": Feature(c("ragged"), c("words"), True, 8),
        "long": Feature(c("long"), c("words"), True, 8),
        "short": Feature(c("short"), c("words"), True, 8),
        "letters": Feature(c("letters"), c("words"), False, 8),
        "ends": Feature(c("ends"), c("words"), False, 8),
        "lines": Feature(c("words"), c("lines"), False, 1),
        "distinct": Feature(c("distinct"), F.pow(c("words"), F.lit(0.75)), False, 4),
    }


def medians(counts: DataFrame, accuracy: int = 10_000) -> dict[str, float]:
    """Each feature's median over all documents that have any of the whole: where texts too short to tell are drawn to."""
    own = features()
    each = [F.percentile_approx(F.when(f.whole > 0, f.part / f.whole), 0.5, accuracy).alias(n) for n, f in own.items()]
    row = counts.agg(*each).first()
    return {n: min(max(row[n] or 0.0, 0.002), 0.998 if f.share else float("inf")) for n, f in own.items()}


def transformed(counts: DataFrame, middle: dict[str, float]) -> DataFrame:
    """Log odds of shares and logs of rates (columns _f_...), each with the median as if the text had `weight` more of it."""
    out = {}
    for n, f in features().items():
        under = F.greatest(f.whole - f.part, F.lit(0.0)) + F.lit(f.weight * (1 - middle[n])) if f.share else f.whole + F.lit(f.weight)
        out[f"_f_{n}"] = F.log((f.part + F.lit(f.weight * middle[n])) / under)
    return counts.select("doc_id", *[c.alias(n) for n, c in out.items()])


# ---- the model


@dataclass(frozen=True)
class Discriminant:
    """For each class (0, 1) with rows: log prior less half the log determinant, mean, and the inverse of its Cholesky factor."""

    names: list[str]
    level: dict[int, float] = field(default_factory=dict)
    mean: dict[int, np.ndarray] = field(default_factory=dict)
    inverse: dict[int, np.ndarray] = field(default_factory=dict)

    def log_density(self, label: int) -> Column:
        """Of the feature columns, with the log prior, less what both classes share."""
        apart = [F.col(f"_f_{n}") - F.lit(float(m)) for n, m in zip(self.names, self.mean[label])]
        total = F.lit(self.level[label])
        for row, weights in enumerate(self.inverse[label]):
            z = F.lit(0.0)
            for w, d in zip(weights[: row + 1], apart):
                z = z + F.lit(float(w)) * d
            total = total - F.lit(0.5) * F.pow(z, F.lit(2.0))
        return total

    def score(self, temperature: float = TEMPERATURE) -> Column:
        if len(self.level) < 2:
            return F.lit(float(next(iter(self.level), 0.5)))
        difference = (self.log_density(1) - self.log_density(0)) / temperature
        return 1 / (1 + F.exp(-difference))


def shrunk(covariance: np.ndarray, n: float) -> np.ndarray:
    """Oracle approximating shrinkage towards the identity times the mean variance."""
    p = len(covariance)
    even, square = np.trace(covariance) / p, (covariance**2).sum()
    over, under = (1 - 2 / p) * square + np.trace(covariance) ** 2, (n + 1 - 2 / p) * (square - np.trace(covariance) ** 2 / p)
    share = 1.0 if under <= 0 else min(1.0, over / under)
    return (1 - share) * covariance + share * even * np.eye(p)


def fit_discriminant(rows: DataFrame, names: list[str], label: str = "label", weight: str = "weight", pooled: float = POOLED) -> Discriminant:
    """Learn from feature columns `_f_{name}`, a class 0 or 1, and how often each row counts."""
    x = [F.col(f"_f_{n}") for n in names]
    w = F.col(weight).cast("double")
    sums = {r[label]: r for r in rows.groupBy(label).agg(F.sum(w).alias("n"), *[F.sum(w * c).alias(f"s{k}") for k, c in enumerate(x)]).collect()}  # two rows
    if not sums:
        return Discriminant(names)
    n = {k: float(r["n"]) for k, r in sums.items()}
    mean = {k: np.array([r[f"s{j}"] for j in range(len(x))]) / n[k] for k, r in sums.items()}
    centre = [F.element_at(F.create_map(*[v for k in sums for v in (F.lit(k), F.lit(float(mean[k][j])))]), F.col(label)) for j in range(len(x))]
    centred = rows.select(label, w.alias("_w"), *[(c - m).alias(f"_d{j}") for j, (c, m) in enumerate(zip(x, centre))])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    scatter = {}
    for r in centred.groupBy(label).agg(*[F.sum(F.col("_w") * F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"v{i}_{j}") for i, j in pairs]).collect():  # two rows
        v = np.zeros((len(x), len(x)))
        for i, j in pairs:
            v[i, j] = v[j, i] = r[f"v{i}_{j}"]
        scatter[r[label]] = v
    common = sum(scatter.values()) / sum(n.values())
    scale = np.sqrt(np.maximum(np.diag(common), 1e-6))  # the identity is one of features of equal spread
    out = Discriminant(names)
    for k in sorted(sums):
        own = ((1 - pooled) * scatter[k] / n[k] + pooled * common) / np.outer(scale, scale)
        factor = np.linalg.cholesky(shrunk(own, n[k]) + 1e-6 * np.eye(len(x)))
        out.level[k] = float(np.log(n[k] / sum(n.values())) - np.log(np.diag(factor)).sum())
        out.mean[k] = mean[k]
        out.inverse[k] = np.linalg.inv(factor) / scale  # the scaling goes into the factor
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _f_...): the features of every document; its counts are written once."""
    counted = checkpointed(counts_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"))
    return transformed(counted, medians(counted))


def labelled(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Features with label and weight: how many rows of labels say so. An id that is often in both tables meets only two rows."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col("doc_id").alias("_of"), F.col(label_col).cast("int").alias("label")).agg(F.count("*").alias("weight"))
    return stats.join(known, F.col("doc_id") == F.col("_of")).drop("_of")


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", pooled: float = POOLED) -> Discriminant:
    """Learn from all rows of labels given."""
    return fit_discriminant(checkpointed(labelled(stats, labels, label_col)), list(features()), pooled=pooled)


def op13_quality(spark, sf_dir: str) -> DataFrame:
    stats = statistics(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(stats, labels.filter(~held_out(F.col("doc_id"))))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
