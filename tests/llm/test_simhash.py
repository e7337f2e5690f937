import random
import re

import numpy as np
import xxhash

from tickweave.llm.simhash import build_tree, components, fingerprint, local_links, near_duplicates, near_pairs, number_leaves, route
from tickweave.llm.common import checkpointed


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius=3):
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def clustered(n, rnd):
    points = set()
    while len(points) < n:
        p = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 30])):
            points.add(p)
            for _ in range(rnd.randint(1, 4)):
                p ^= 1 << rnd.randrange(64)
    return sorted(points)[:n]


def test_fingerprints():
    for t in ["", " \n", "A b", "A", "a b c d É e\x0bf\x1cg  h", "x " * 900, "The the tHe the"]:
        assert fingerprint(t) == brute_fingerprint(t), t


def test_trees_prune_nothing_that_is_near():
    rnd = random.Random(3)
    points = np.array(clustered(1200, rnd), np.uint64)
    tree, leaves = number_leaves(build_tree(points[::4], 20))
    assert leaves > 5
    home = dict(zip(*[x.tolist() for x in route(tree, points, 0)]))
    visits = set(zip(*[x.tolist() for x in route(tree, points, 3)]))
    for i in range(len(points)):
        for j in range(i):
            if int(points[i] ^ points[j]).bit_count() <= 3:
                assert (i, home[j]) in visits and (j, home[i]) in visits
    root = local_links(points, points, 3)
    expected = brute_components(points.tolist())
    groups = {}
    for a, b in zip(root.tolist(), expected):
        assert groups.setdefault(a, b) == b
    assert len(groups) == len(set(expected))


def test_pairs_and_components_over_shards(spark):
    rnd = random.Random(9)
    points = clustered(900, rnd)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    df = checkpointed(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3))
    for size in (60, 5, 1):
        roots = {r.node: r.root for r in components(near_pairs(df, 3, size)).collect()}
        expected = brute_components(points)
        label = {}
        for p, e in zip(signed, expected):
            label.setdefault(e, set()).add(roots.get(p, p))
        assert all(len(v) == 1 for v in label.values()) and len({min(v) for v in label.values()}) == len(label)


def test_a_crowded_shard_is_cut(spark):
    rnd = random.Random(4)
    points = {0}
    while len(points) < 500:  # one ball, which a tree can't part well
        points.add(sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))))
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    df = checkpointed(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in components(near_pairs(df, 3, 10, 16)).collect()}
    label = {}
    for p, e in zip(signed, brute_components(points)):
        label.setdefault(e, set()).add(roots.get(p, p))
    assert all(len(v) == 1 for v in label.values())


def test_documents(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(300)) for _ in range(12)]
    texts = [None, "", " \t", "one", "one two", "ONE two"] + base + base[:3]
    for b in base:
        w = b.split()
        w[rnd.randrange(300)] = word()
        texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, component_id string")
    rows = {r.doc_id: r for r in near_duplicates(df, shard_size=4).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    group = brute_components(prints)
    assert len(rows) == len(texts)
    for i, p, g in zip(ids, prints, group):
        assert rows[i].fp & (2**64 - 1) == p
        assert rows[i].component_id == min(k for k, h in zip(ids, group) if h == g)
    assert near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(null).collect()) == [(0, 0), (0, 0), (7, 7)]
