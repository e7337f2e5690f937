import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickweave.llm import topk
from tickweave.llm.topk import top_inner_products


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = {}
    for i, v in good:
        if i % 50 == 0:
            found.setdefault(i, []).extend((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)
    out = [(i, n + 1, j, -s) for i, scores in found.items() for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "small blocks", "one length", "odd"])
def test_against_brute_force(spark, monkeypatch, kind):
    rnd = random.Random(len(kind))
    value = lambda: rnd.choice([0.0, 0.5, -0.5]) if kind == "ties" else float(rnd.gauss(0, 0.3))
    rows = [(i, [value() * (1 + i % 7) for _ in range(12)]) for i in range(700)]
    if kind == "odd":
        rows += [(None, [1.0] * 12), (1000, None), (1001, [1.0, None] * 6), (1050, [float("nan")] * 12), (1100, [float("inf")] * 12), (1150, []), (1200, [0.3] * 5), (1250, [0.1] * 20), (50, [9.0] * 12), (7, rows[7][1]), (1300, [1e30] * 12)]
    if kind == "one length":
        rows = [(i, [0.5] * 12 if i % 3 else [0.5 * (-1) ** (i % 2)] + [0.5] * 11) for i in range(700)]
    if kind in ("small blocks", "one length"):
        for name, v in (("QUERY_BLOCK", 6), ("HEAD", 10), ("CHUNK", 16), ("BAND", 100), ("SAMPLE", 50)):
            monkeypatch.setattr(topk, name, v)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = sorted(tuple(r) for r in top_inner_products(df, F.col("vec_id") % 50 == 0).collect())
    if kind == "odd":  # one vector is beyond 64 bits; its queries' scores are cut
        got, want = ([r for r in x if abs(r[3]) < 2**62 and r[0] != 1300] for x in (got, brute(rows)))
        assert [r for r in got if 1300 not in r] == [r for r in want if 1300 not in r]
    else:
        assert got == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_inner_products(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 131072)]
    assert top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_queries_agree_with_sql(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(0, 300), [rnd.gauss(0, 1) for _ in range(8)]) for _ in range(900)] + [(50, [2.0] * 8)] * 3 + [(None, [1.0] * 8), (100, None), (150, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in topk.op8_top_k(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"select query_id, rank, vec_id, score from ({topk.OP8_SQL})").fetchall())


def test_steps_prune(spark):
    """Vectors of few directions: the partial sums leave next to nothing for exact products."""
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) for _ in range(32)] for _ in range(4)]
    rows = [(i, [(1 + i % 9) * x + rnd.gauss(0, 0.02) for x in base[i % 4]]) for i in range(3000)]
    report = spark.sparkContext.accumulator([0] * (len(topk.STEPS) + 2), topk.PairCounts())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_inner_products(df, F.col("vec_id") % 50 == 0, report=report).collect()) == brute(rows)
    by_length, *by_step, left = report.value
    assert by_length + sum(by_step) + left >= 60 * 2999 and by_length > 0 and by_step[0] > 0 and left < 0.1 * 60 * 3000
