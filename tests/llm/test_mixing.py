import random
import re
from collections import defaultdict

from tickweave.llm.mixing import PACKETS, SEED, deal, mix, word_count
from pyspark.sql import functions as F


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left > 3 * sizes[s] * w]
        if not over:
            return {**{s: 3.0 * sizes[s] for s in stopped}, **{s: weight[s] * left / w for s in open_}}
        stopped |= set(over)


def brute_takes(spark, rows, parts=PACKETS, tie=None):
    """Plain weighted fair queueing: {row: words} of the packets in order of finish time, up to the budget."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    df = spark.createDataFrame([(k, r[0], tie[k] if tie else r[1], r[2]) for k, r in enumerate(rows)], "k long, doc_id long, text string, source string")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    order = {r.k: (r.o, r.doc_id is not None, r.doc_id, r.t) for r in df.select("k", "doc_id", h.alias("t"), F.xxhash64("doc_id", h, F.lit(SEED)).alias("o")).collect()}
    size = [words(r[1]) for r in rows]
    sources = defaultdict(list)
    for k, r in enumerate(rows):
        sources[r[2]].append(k)
    budget, all_packets = sum(size), []
    target = brute_targets({s: sum(size[k] for k in ks) for s, ks in sources.items()})
    packet = max(1, -(-budget // parts))
    for s, ks in sources.items():
        at = 0
        for _ in range(3):
            for k in sorted(ks, key=lambda k: order[k]):
                for low in range(0, size[k], packet):
                    n = min(packet, size[k] - low)
                    all_packets.append(((at + n) / target[s], s is None, s or "", at, k, n))
                    at += n
    takes = [0] * len(rows)
    for *_, k, n in sorted(all_packets):
        n = min(n, budget)
        takes[k] += n
        budget -= n
    return takes, target, packet


def run(spark, rows, parts=PACKETS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, extra int")
    got = deal(df, parts=parts).collect()
    takes, targets, packet = brute_takes(spark, rows, parts)
    want = sorted(((r[0] or -1, r[2] or "", n) for r, n in zip(rows, takes)))
    assert sorted((r.doc_id or -1, r.source or "", sum(d["take"] for d in r.dealt)) for r in got) == want
    taken, sizes = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and abs(r.target - targets[r.source]) < 1e-9 * max(1, r.target)
        assert all(0 < d["take"] <= r.size for d in r.dealt)
        taken[r.source] += sum(d["take"] for d in r.dealt)
        sizes[r.source] += r.size
    assert sum(taken.values()) == sum(sizes.values()) and all(r.source_size == sizes[r.source] for r in got)
    assert all(abs(taken[s] - t) <= packet * len(targets) for s, t in targets.items())
    return df, got


def test_targets_and_takes(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        s = rnd.choice(["a", "b", "c", "d", "é", "\U0001f600", "￮", None, "tiny"]) if i % 3 else "hot"
        n = 1 if s == "tiny" else rnd.choice([0, 1, 3, 50, 400])
        rows.append((i, " \t".join("w" * (1 + k % 3) for k in range(n)) if n else rnd.choice([None, "", " \n"]), s, "clash", 1))
    run(spark, rows, 100)
    df, got = run(spark, rows)
    order = [(r.doc_id, r["pass"], r.take) for r in mix(deal(df)).collect()]
    assert order == [(r.doc_id, r["pass"], r.take) for r in mix(deal(df.repartition(7))).collect()]
    assert sum(t for *_, t in order) == sum(d["take"] for r in got for d in r.dealt)
    finish = [r.finish for r in mix(deal(df)).collect()]
    assert finish == sorted(finish)


def test_edges(spark):
    run(spark, [])
    run(spark, [(1, None, None, "", 1), (1, "", "a", "", 1)])
    run(spark, [(1, "a b c", "x", "", 1)] * 3 + [(2, "word " * 5000, "y", "", 1)])


def test_words(spark):
    t = "a b \x0b c\x1cd\x0d\n e f"
    assert spark.range(1).select(word_count(F.lit(t))).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", t))
