import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tickweave.llm.common import checkpointed
from tickweave.llm.packing import Encoder, pack, token_pieces, vector_best_fit


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    e, rnd = Encoder(), random.Random(4)
    white = ["  ", "\n", "\t ", " \n ", "\x1c", "\x85", "\xa0", "\u3000", "\r\n"]
    chars = [chr(c) for c in range(0x260)] + list("  \n\n''sdtlm 123 aé") * 12 + white
    sample = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    sample += ["".join(rnd.choice([" ", "a", "1", ".", *white]) for _ in range(rnd.randint(0, 9))) for _ in range(4000)]
    sample += ["".join(chr(rnd.choice([32, rnd.randrange(32, 127), rnd.randrange(0x300, 0x3000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(20)) for _ in range(2000)]
    sample += ["", " ", "\n\n x", "a <|endoftext|> b", "日本 text", "a" * 50000, "a" * 50000 + " b", "don't  we'll \t\n you"]
    sample += [TOKENIZER.decode([k]) + tail for k in range(0, 50256, 7) for tail in ("", " x")]
    for text, ids in zip(sample, e.ids(pa.array(sample))):
        assert ids.tolist() == plain_ids(text), repr(text)
    assert e.ids(pa.array([], pa.string())) == [] and [x.tolist() for x in e.ids(pa.array(["", "x", "y"]).slice(1))] == [plain_ids("x"), plain_ids("y")]


def plain_best_fit(lengths, cap, weights):
    """One piece at a time into the open sequence with the least weighted residual norm."""
    bins = []
    for n in sorted(lengths, reverse=True):
        v = (n, 1, n * n)
        fits = [b for b in bins if all(r >= x for r, x in zip(b, v))]
        if not fits:
            bins.append(list(cap))
            fits = bins[-1:]
        best = min(fits, key=lambda b: sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, b, v, cap)))
        for k in range(3):
            best[k] -= v[k]
    return len(bins)


@pytest.mark.parametrize("cap", [(64, 64, 4096), (64, 4, 4096), (64, 64, 900), (64, 3, 1500)])
def test_plan_has_as_many_sequences_as_plain_best_fit(cap):
    rnd = random.Random(5)
    for _ in range(20):
        lengths = [min(30, int(rnd.expovariate(1 / 9)) + 1) for _ in range(rnd.choice([5, 60, 400]))]
        plan = vector_best_fit(dict(Counter(lengths)), cap)
        assert sum(many for many, _ in plan) == plain_best_fit(lengths, cap, (1.0, 0.01, 0.01))


def test_every_capacity_changes_the_plan():
    counts = {n: 40 for n in range(1, 31)}
    sequences = {cap: sum(many for many, _ in vector_best_fit(counts, cap)) for cap in ((64, 64, 4096), (64, 3, 4096), (64, 64, 900))}
    assert sequences[64, 3, 4096] > sequences[64, 64, 4096] < sequences[64, 64, 900]
    kinds = lambda w: sorted(map(str, vector_best_fit(counts, (64, 6, 1200), w)))
    assert kinds((1.0, 0.01, 0.01)) != kinds((0.01, 1.0, 0.01)) != kinds((0.01, 0.01, 1.0))


def test_plan_is_whole_and_within_capacities():
    rnd = random.Random(1)
    for score in ("norm", "dot"):
        for cap in ((64, 64, 4096), (64, 5, 4096), (64, 64, 1500)):
            top = min(64, int(cap[2] ** 0.5))
            counts = Counter(min(top, int(rnd.expovariate(1 / 20)) + 1) for _ in range(3000))
            plan = vector_best_fit(dict(counts), cap, score=score)
            used = Counter()
            for many, lengths in plan:
                assert sum(lengths) <= cap[0] and len(lengths) <= cap[1] and sum(n * n for n in lengths) <= cap[2]
                used.update({k: v * many for k, v in Counter(lengths).items()})
            assert used == counts
            if cap == (64, 64, 4096) and score == "norm":
                assert sum(many for many, _ in plan) <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 64)
    with pytest.raises(ValueError):
        vector_best_fit({65: 1}, (64, 64, 10**6))


def test_rows(spark):
    rnd = random.Random(8)
    texts = [None, "", "x"] + [" ".join(rnd.choice(["the", "word", "é", "zz9"]) for _ in range(rnd.choice([1, 30, 400, 1500, 5000]))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)] + [(None, "null id", 5, "c")] * 2, "doc_id long, text string, length int, piece string")
    rows = pack(checkpointed(token_pieces(df))).collect()
    seen = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.append(plain_ids(t or ""), 2).astype("<u4")
        pieces = sorted(seen[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 1024 for r in pieces[1:]) and pieces[0].start == 0
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert len(seen[None]) == 2
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= 1.05 * -(-sum(r.length for r in rows) // 1024) + 1
    assert pack(checkpointed(token_pieces(df.limit(0)))).count() == 0
    with_ids = token_pieces(df.filter("doc_id = 2"), with_ids=True).first()
    assert zlib.crc32(with_ids.ids) == with_ids.ids_crc32
