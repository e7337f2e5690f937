"""The registered queries over whole tables against plain versions of what they must return."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import test_mixing
import test_packing
import test_pii
import test_secrets
import test_simhash
from tickweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def rows_of(spark, prefix):
    return QUERIES[next(n for n in QUERIES if n.startswith(prefix))](spark, SF).collect()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


@pytest.mark.parametrize("op, brute, kinds", [("op2_", test_pii.brute, ["email", "ip", "card", "phone"]), ("op9_", test_secrets.brute, ["assign", "access", "hex"])])
def test_span_queries(spark, texts, op, brute, kinds):
    rows = rows_of(spark, op)
    assert len(rows) == len(texts)
    for r in rows:
        base = [s for s in brute(texts[r.doc_id] or "") if s[0] in kinds]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds] and r.base_sha256 == digest(base)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))  if base else True


def test_op3(spark, texts):
    rows = rows_of(spark, "op3_")
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(counts.values()) - min(counts.values()) <= 1 and {r.law for r in rows} == {"rows"}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_op4(spark, texts):
    seen, fill = defaultdict(list), Counter()
    rows = rows_of(spark, "op4_")
    for r in rows:
        seen[r.doc_id].append(r)
        fill[r.sequence_id] += r.length
    for i, t in texts.items():
        ids = np.append(test_packing.plain_ids(t), 2).astype("<u4")
        at = 0
        for r in sorted(seen[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert max(fill.values()) <= 1024 and len(fill) <= 1.03 * -(-sum(fill.values()) // 1024)


def test_op5(spark, texts):
    for r in rows_of(spark, "op5_"):
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_op7(spark, texts):
    rows = {r.doc_id: r for r in rows_of(spark, "op7_")}
    source = dict(duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet'").fetchall())
    ids, total = sorted(texts), sum(r["size"] for r in rows.values())
    # the query passes a hash for each text, so equal hashes stand for equal texts here too
    hashes = dict(spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", F.xxhash64("text").cast("string")).collect())
    takes, targets, packet = test_mixing.brute_takes(spark, [(i, texts[i], source[i]) for i in ids], tie=[hashes[i] for i in ids])
    assert [rows[i].taken for i in ids] == takes and sum(takes) == total
    assert all(0 <= r.taken <= 3 * r["size"] and abs(r.target - targets[source[i]]) < 1e-6 for i, r in rows.items())


def test_op8(spark):
    import test_topk

    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows_of(spark, "op8_")) == test_topk.brute(rows)


def test_op10(spark, texts):
    rows = {r.doc_id: r for r in rows_of(spark, "op10_")}
    ids = sorted(texts)
    prints = [test_simhash.brute_fingerprint(texts[i]) for i in ids]
    group = test_simhash.brute_components(prints)
    least = {}
    for i, g in zip(ids, group):
        least.setdefault(g, i)
    assert all(rows[i].fingerprint == f"{p:016x}" and rows[i].component_id == least[g] for i, p, g in zip(ids, prints, group))
    assert json.dumps(sorted(rows)) == json.dumps(ids)
