import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from test_mixing import brute_targets
from test_secrets import brute as brute_secrets
from test_similar import brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = ["the", "house", "tree", "green", "walks", "over", "with"], ["der", "haus", "baum", "grün", "geht", "über", "mit"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(120):
        words = [rnd.choice(EN if i % 2 else DE) + rnd.choice(["", "s", "er", "en"]) for _ in range(rnd.choice([3, 40, 300]))]
        text = " ".join(words)
        if i % 10 == 3:
            text += " token = 'abcdef0123456789' end"
        if i > 60 and i % 6 == 0:
            text = out[i - 60][1]
        out.append((i, text, ["de", "en"][i % 2] if i % 7 else None, f"src{i % 4}" if i % 9 else None, len(text)))
    out += [(200, None, "en", "src0", 0), (201, "123 !!", "en", "src1", 6), (202, "", None, None, 0), out[5], (None, "der baum über dem haus mit", "de", "src1", 26)]
    return out


def test_stages_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [tuple(r) for r in P.language_id(spark, docs, "").collect()]
    letters = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert Counter((r[0], r[1]) for r in kept) == Counter((r[0], r[1]) for r in letters)
    assert all(r[2] in ("de", "en") for r in kept)

    docs = spark.createDataFrame(kept, SCHEMA)
    single = [tuple(r) for r in P.simhash_dedup(spark, docs, "").collect()]
    group = brute_groups([r[1] for r in kept])
    least = {}
    for r, g in zip(kept, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = {r[0]: r for r, g in zip(kept, group) if r[0] is not None and least[g] == r[0]}
    assert Counter(single) == Counter([*want.values(), *(r for r in kept if r[0] is None)])

    docs = spark.createDataFrame(single, SCHEMA)
    clean = {r.doc_id: r for r in P.secret_scan(spark, docs, "").collect()}
    assert len(clean) == len(single)
    for r in single:
        found = brute_secrets(r[1])
        if found:
            assert not brute_secrets(clean[r[0]].text) and clean[r[0]].n_chars == len(clean[r[0]].text)
        else:
            assert tuple(clean[r[0]]) == r

    docs = spark.createDataFrame([tuple(r) for r in clean.values()], SCHEMA)
    mixed = P.mix_sources(spark, docs, "").collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, often = Counter(), Counter(), Counter()
    for r in clean.values():
        sizes[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
        often[r.doc_id] += 1
        assert clean[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text) and r.lang == clean[r.doc_id].lang
    targets = brute_targets(dict(sizes))
    assert sum(taken.values()) == sum(sizes.values()) and all(abs(taken[s] - t) <= len(targets) for s, t in targets.items())
    assert max(often.values()) <= 3

    packed = P.best_fit_packing(spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == often
    assert max(Counter((r.sequence_id, r.offset) for r in packed).values()) == 1


def test_run_and_empty_input(spark, tmp_path, rows):
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = P.run(spark, str(tmp_path / name))
        assert (out.count() > 50) == bool(data)
        assert [c for c, _ in out.dtypes] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_one_language_or_none(spark):
    """A corpus of one language, or without labels, keeps every document that has letters."""
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en'")
    empty = spark.createDataFrame([(-1, " 12 ", "en", "s", 4), (-2, None, "en", "s", 0)], docs.schema)
    kept = {r.doc_id for r in P.language_id(spark, docs.union(empty), "").select("doc_id").collect()}
    letters = {r.doc_id for r in docs.filter(docs.text.rlike(r"\p{L}")).select("doc_id").collect()}
    assert kept == letters and len(kept) > 100
    bare = docs.union(empty).withColumn("lang", docs.lang.substr(9, 1)).replace("", None, ["lang"])
    assert {r.doc_id for r in P.language_id(spark, bare, "").select("doc_id").collect()} == letters
