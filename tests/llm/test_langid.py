import math
import random
import re
from collections import Counter, defaultdict
import zlib

import duckdb

from tickweave.llm.langid import held_out, op6_language_id, predict, train
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op6_language_id(spark, SF).collect()
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print("accuracy", right, "lowest scores", sorted(r.score for r in rows)[:10])
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_cases(spark):
    train_rows = [(i, t, l) for i in range(12) for t, l in (("the house and the tree", "en"), ("das haus und der baum", "de"))] + [(99, None, "en"), (98, "nichts", None)]
    model = train(spark.createDataFrame(train_rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 _ ! ½ ²", 1.0), (4, "der und", 1.0), (5, "trees", 1.0), (6, "the and " * 50000, 1.0), (4, "der und", 1.0)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict(df, model).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "de", "en", "en", "de"] and got[0][2] == 0.0 and got[3] == got[6]
    assert predict(df.limit(0), model).count() == 0
    none = train(df.limit(0).withColumn("lang", F.lit("x")))
    assert [r.lang_pred for r in predict(df, none).collect()] == ["und"] * 7


def test_sample_is_bounded_and_stable(spark):
    rows = [(i, f"word{i % 7} und", "de") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = train(df, sample_rows=100), train(df.repartition(5), sample_rows=100)
    assert a.words == b.words and (a.table == b.table).all()


def test_null_id_is_not_held_out(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out(F.col("doc_id"))).first()[0] is False


def brute_model(rows):
    """{order: {word: [count of each language]}} of (text, lang) rows, plainly; order 0 holds the words seen three times."""
    languages = sorted({lang for _, lang in rows})
    words = {lang: Counter(w for t, own in rows if own == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in languages}
    tables = {o: defaultdict(lambda: [0] * len(languages)) for o in (0, 1, 2, 3, 4)}
    for k, lang in enumerate(languages):
        for w, n in words[lang].items():
            if n >= 3:
                tables[0][w][k] = n
            for o in (1, 2, 3, 4):
                for at in range(len(w) + 3 - o):
                    tables[o][f"^{w}$"[at : at + o]][k] += n
    return languages, tables


def brute_predict(text, languages, tables):
    total = {o: [sum(n[k] + 0.5 for n in t.values()) for k in range(len(languages))] for o, t in tables.items()}
    log = lambda o, w: [math.log((n + 0.5) / s) for n, s in zip(tables[o][w], total[o])]
    each = []
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in tables[0]:
            each.append(log(0, w))
            continue
        marked, found = f"^{w}$", []
        for at in range(len(marked)):
            o = next((o for o in (4, 3, 2, 1) if at + o <= len(marked) and marked[at : at + o] in tables[o]), None)
            if o:
                found.append(log(o, marked[at : at + o]))
        each.append([sum(c) / len(found) for c in zip(*found)] if found else [0.0] * len(languages))
    if not each:
        return "und", 0.0
    level = [sum(c) / len(each) * min(len(each), 12) for c in zip(*each)]
    odds = [math.exp(x - max(level)) for x in level]
    best = max(range(len(odds)), key=lambda k: (odds[k], -k))
    return languages[best], odds[best] / sum(odds)


def test_against_a_plain_scorer(spark):
    rnd = random.Random(6)
    syllables = {f"l{k:02d}": [chr(97 + (k * 7 + j * 3) % 26) + "aeiou"[(k + j) % 5] for j in range(9)] for k in range(70)}
    write = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, write(lang, rnd.choice([2, 20, 60])), lang) for i, lang in enumerate(sorted(syllables) * 5)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(syllables)  # seventy of them: none is left out
    asked = [write(lang, n) for lang in ("l03", "l40", "l69") for n in (1, 3, 30)] + ["", "123", "zzzz unseen", "ÉÀ straße", rows[3][1]]
    got = predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    plain = brute_model([r[1:] for r in rows])
    for text, r in zip(asked, got):
        lang, score = brute_predict(text, *plain)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, text


def test_sample_gives_each_language_its_share(spark):
    rows = [(i, f"word{i}x common", "big") for i in range(3000)] + [(9000 + i, f"seltsam{i}y", "rare") for i in range(20)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    assert model.languages == ["big", "rare"] and "^sel" in model.grams[4]
    small = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=1, grams=2)
    assert len(small.words) <= 2 and all(len(g) <= 4 for g in small.grams.values())


def test_a_model_goes_with_its_memory_of_words(spark):
    """A worker that drops a model has its memory back at once, not when Python looks for cycles."""
    import gc
    import weakref

    from tickweave.llm.langid import Predictor

    rows = [(k, text, lang) for k, (text, lang) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de")] * 5)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model.predictor = Predictor(model)
    first = model.predictor.predict(model, "the doghouse")
    assert first[0] == "en" and first == model.predictor.predict(model, "the doghouse")  # once made, once remembered
    gone = weakref.ref(model)
    gc.disable()
    try:
        del model
        assert gone() is None
    finally:
        gc.enable()


def test_labelled_rows_without_letters_teach_nothing(spark):
    df = spark.createDataFrame([(1, "12 34", "en"), (2, "word", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(df, train(df)).collect()}
    assert got == {1: ("und", 0.0), 2: ("en", 1.0)}


def test_texts_come_in_small_batches(spark):
    from tickweave.llm.common import small_batches

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=batch["text"].str.len().sum())[["n"]].head(1)

    df = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 1000) as text")
    found = [r.n for r in small_batches(df).mapInPandas(sizes, "n long").collect()]
    assert sum(found) == 3_000_000 and max(found) <= 1_100_000
