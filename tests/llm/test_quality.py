"""Counts against Python's, the discriminant against numpy's densities, the query by held-out accuracy."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm.quality import (
    POOLED, TEMPERATURE, counts_of, features, fit_discriminant, held_out, labelled, medians, op13_quality, shrunk, statistics, train, transformed,
)

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n\t ", "One two two three.", "ÉCOLE!! ça va? 12 | 34 | ***\nend", "a b c\x0bd", "漢字 ok 𝒳yz", "Wher. Wher. Wher.", "x" * 3000 + " " + "y " * 3000]


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    letter = str.isalpha  # letters proper: no numerals of letter form are in TEXTS
    return {
        "chars": len(text), "letters": sum(map(letter, text)), "upper": sum(c.isupper() for c in text), "digits": sum(c in "0123456789" for c in text),
        "spaces": sum(c in " \t\n\x0b\x0c\r" for c in text), "lines": text.count("\n") + 1, "ends": sum(c in ".!?" for c in text), "words": len(words), "distinct": len(set(words)),
        "again": sum(a == b for a, b in zip(words, words[1:])), "bare": sum(not any(letter(c) or c in "0123456789" for c in w) for w in words),
        "ragged": sum(len(w) > 1 and not any(letter(c) or c in "0123456789" for c in w[-2:]) for w in words), "long": sum(len(w) > 12 for w in words), "short": sum(len(w) <= 3 for w in words),
    }


def test_counts(spark):
    df = counts_of(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    for r in df.collect():
        assert {k: r[f"c_{k}"] for k in counts("")} == counts(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_discriminant(spark):
    """Scores are the posterior of normal densities with the shrunk covariances, by numpy."""
    r = np.random.default_rng(2)
    p, names = 5, list("abcde")
    x = np.vstack([r.normal(size=(60, p)) @ r.normal(size=(p, p)) + 1, r.normal(size=(25, p)) * 3])
    y, w = np.array([1] * 60 + [0] * 25), r.integers(1, 4, 85)
    df = spark.createDataFrame([(*map(float, v), int(k), int(n)) for v, k, n in zip(x, y, w)], ", ".join(f"_f_{n} double" for n in names) + ", label int, weight long")
    model = fit_discriminant(df, names)
    parts, mean, n = {}, {}, {}
    for k in (0, 1):
        rows, own = x[y == k], w[y == k]
        n[k], mean[k] = own.sum(), (own[:, None] * rows).sum(0) / own.sum()
        parts[k] = ((rows - mean[k]) * own[:, None]).T @ (rows - mean[k])
    common = (parts[0] + parts[1]) / w.sum()
    s = np.sqrt(np.diag(common))

    def density(k):
        c = shrunk(((1 - POOLED) * parts[k] / n[k] + POOLED * common) / np.outer(s, s), n[k]) + 1e-6 * np.eye(p)
        d = (x - mean[k]) / s
        return np.log(n[k] / w.sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)

    want = 1 / (1 + np.exp(-(density(1) - density(0)) / TEMPERATURE))
    got = np.array([r.score for r in df.select(model.score().alias("score")).collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_shrinkage():
    v = np.diag([1.0, 4.0, 9.0])
    assert np.allclose(np.trace(shrunk(v, 10)), 14) and np.allclose(shrunk(v, 1e9), v, atol=1e-6) and np.allclose(shrunk(np.zeros((3, 3)), 1), 0)


def test_query(spark):
    """Held-out documents: nearly all are told right, and clean ones stay, the shortest included."""
    got = {r.doc_id: r for r in op13_quality(spark, SF).collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    ids = [i for (i,) in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()]
    assert sorted(got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    unseen = [i for i in labels if got[i].held_out]
    right = [got[i].predicted == labels[i] for i in unseen]
    assert len(unseen) > 50 and sum(right) / len(right) > 0.97
    good, bad = ([got[i].score for i in unseen if labels[i] == k] for k in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.99  # area under the curve


def test_labels_decide_alone(spark):
    """No label of a held-out document, no lang, source or id matters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    stats = statistics(docs)
    learnt = labels.filter(~held_out(F.col("doc_id")))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).filter(~held_out(F.col("doc_id")))
    one, other = (train(stats, x) for x in (learnt, turned))
    assert one.level == other.level and all(np.array_equal(one.inverse[k], other.inverse[k]) for k in one.inverse)


def test_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text number {i} is here. " * (i % 7), "k") for i in range(40)] + [(3, None, "k"), (3, "", "k"), (None, "no id", "k")], "doc_id long, text string, label string")
    stats = statistics(docs)
    score = lambda rows: {round(r.score, 9) for r in stats.select(train(stats, spark.createDataFrame(rows, "doc_id long, quality int")).score().alias("score")).collect()}
    assert score([]) == {0.5} and score([(1, None), (2, 7), (None, 1)]) == {0.5}
    assert score([(1, 1), (2, 1), (3, 1)]) == {1.0} and score([(1, 0)]) == {0.0}
    assert all(0 <= s <= 1 and not math.isnan(s) for s in score([(1, 0), (2, 1)]))
    weights = labelled(stats, spark.createDataFrame([(3, 1)] * 5 + [(3, 0)], "doc_id long, quality int"))
    assert sorted((r.label, r.weight) for r in weights.collect()) == [(0, 1)] * 3 + [(1, 5)] * 3


def test_medians_of_nothing(spark):
    empty = counts_of(spark.createDataFrame([], "doc_id long, text string"))
    assert set(medians(empty)) == set(features()) and transformed(empty, medians(empty)).count() == 0


@pytest.mark.parametrize("text", TEXTS)
def test_every_text_has_features(spark, text):
    row = statistics(spark.createDataFrame([(1, text), (2, "Some words. And more of them, here.")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert all(v is not None and math.isfinite(v) for k, v in row.asDict().items() if k != "doc_id")
