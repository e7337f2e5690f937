import random
import re

import corpus_pipeline as P
from tickweave.llm.similar import similar_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets, up = [brute_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def texts_of(rnd):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = [None, "", " \t", "one", "one two", "ONE two", "x " * 90, "x " * 40]
    for n in (6, 30, 200, 400):
        for _ in range(6):
            base = [word() for _ in range(n)] + (passage if n == 200 else [])
            out.append(" ".join(base))
            for changes in (1, 2, n // 50, n // 45, n // 40, n // 20):  # similarities on both sides of 0.8
                copy = list(base)
                for at in rnd.sample(range(n), min(n, changes)):
                    copy[at] = word()
                out.append(" ".join(copy))
    base = [word() for _ in range(150)]
    for _ in range(60):  # one large group, of which many pairs are linked by chains alone
        copy = list(base)
        copy[rnd.randrange(150)] = word()
        copy[rnd.randrange(150)] = word()
        out.append(" ".join(copy))
    rnd.shuffle(out)
    return out


def test_all_pairs_are_found(spark):
    texts = texts_of(random.Random(8))
    want = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for how in ({}, {"sample_size": 20, "frequent": 50, "pivot_rounds": 1}):
        got = {r.doc_id: r.component_id for r in similar_documents(df, **how).collect()}
        assert [got[i] for i in range(len(texts))] == want
    # a document without doc_id links two that are not similar
    words = [f"w{k}" for k in range(100)]
    chain = [" ".join(words[k : k + 60]) for k in (0, 5, 10)]
    df = spark.createDataFrame([(4, chain[0]), (None, chain[1]), (9, chain[2])], "doc_id long, text string")
    assert sorted(r.component_id for r in similar_documents(df).collect()) == [4, 4, 4]
    assert similar_documents(df.limit(0)).count() == 0


def test_stage_drops_near_copies_and_no_other(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(200)]
    near, far = list(base), list(base)
    for at in (20, 90, 160):
        near[at] = word()
    for at in range(5, 200, 25):
        far[at] = word()
    # one passage repeated, of which op10's fingerprints hardly show the other words
    loud = [" ".join(["same old line again and"] * 200 + [word() for _ in range(100)]) for _ in range(2)]
    texts = [" ".join(base), " ".join(near), " ".join(far), *loud]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, docs, "").collect()) == [0, 2, 3, 4]


def test_parities_never_differ_more_than_their_sets():
    import numpy as np

    from tickweave.llm.similar import parities, shingle_set

    rnd = random.Random(4)
    for n in (0, 1, 50, 700, 4000):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        other = [w if rnd.random() < 0.95 else f"v{rnd.randrange(10**6)}" for w in words]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        apart = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and parities(a).dtype == np.int64 and len(parities(a)) == 8
        assert not (parities(a) ^ parities(a)).any()


def test_the_stage_goes_through_the_trees(spark, monkeypatch):
    """Every fingerprint goes to operator 10's trees; what they link alone are pairs that are similar, and the join has no more to do for such families."""
    from tickweave.llm import similar as S

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(400)]
        texts += [" ".join([*base, *(word() for _ in range(k))]) for k in range(4)]
    short = ["one two", "a b c d e f"]  # alike by no set
    df = spark.createDataFrame(list(enumerate([*texts, *short])), "doc_id long, text string")
    seen, plain = [], S.near_pairs

    def watched(distinct, *args, **how):
        seen.append({r.fp for r in distinct.collect()})
        return plain(distinct, *args, **how)

    monkeypatch.setattr(S, "near_pairs", watched)
    prints = S._prints(df, 5, 80, S._order(df, 5, 100, 100)).cache()
    links = S.tree_links(df, prints).collect()
    assert seen == [{r.print for r in prints.collect()}]
    doc = {r.fp: r.doc_id for r in prints.collect()}
    assert len(links) >= 12 and all(doc[r.a] // 4 == doc[r.b] // 4 for r in links)
    docs = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, docs, "").collect()) == [*range(0, 32, 4), 32, 33] and len(seen) == 2
