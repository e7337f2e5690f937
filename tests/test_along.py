"""Rows dealt to many tasks: long groups in stretches, batches with the rows before them, tasks by the number of rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from test_factors import BY, ORDER, make

from tickweave.functions import along as A
from tickweave.operators import evaluation as E
from tickweave.operators import ingest as I
from tickweave.operators.factors import run_factor
from tickweave.plans import adapters, queries

SF = "/root/testdata/sf0.001"
WINDOWS = {
    "bap": {"20t": 20}, "mom": {"5t": 5, "20t": 20}, "acc_mom": {"5_10t": (5, 10)}, "amp_slice": {"40t": 40}, "rigidity": {"20t": 20},
    "neg_skew": {"15t": 15}, "pv_corr": {"6t": 6}, "rsrs": {"20t": 20}, "oir": {"20t": 20}, "ofd": {"20t": 20},
}


@pytest.fixture(scope="module")
def ticks(spark):
    frames = [make(n=900, seed=3).assign(security_id="s"), make(n=70, seed=4).assign(security_id="t")]
    rows = [r for p in frames for r in p.astype(object).where(p.notna(), None).values.tolist()]
    kinds = {"date": "string", "security_id": "string", "tick_idx": "int"} | {c: "boolean" for c in frames[0] if c.startswith("CanUse")}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in frames[0])).repartition(5).cache()


@pytest.mark.parametrize("name", WINDOWS)
def test_long_groups_in_stretches(spark, ticks, name, monkeypatch):
    own = lambda df: sorted(map(tuple, df.select("security_id", "tick_idx", *[c for c in df.columns if c.startswith(name)]).collect()))
    whole = own(run_factor(ticks, name, BY, ORDER, WINDOWS[name]))
    monkeypatch.setattr(A, "STRETCH", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        cut = run_factor(ticks.withColumn("_pos", F.col("tick_idx")), name, BY, ORDER, WINDOWS[name], keep=[], tasks=16)
        found = own(cut)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut.select(F.spark_partition_id().alias("p"), "security_id").distinct().filter("security_id = 's'").count() > 1
    assert len(found) == len(whole) == 970
    for a, b in zip(whole, found):
        assert all(abs(x - y) <= 1e-9 * max(1, abs(x)) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_long_base_numbers_across_tasks(spark):
    got = adapters.long_base(spark, SF).select("security_id", "tick_idx", "CumVolume")
    order = W.partitionBy("security_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    items = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("security_id", F.col("l_suppkey") % 10)
    want = items.select("security_id", (F.row_number().over(order) - 1).alias("tick_idx"), F.sum("l_quantity").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("CumVolume"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    assert A.tasks_for(spark, 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert A.tasks_for(spark, 10 * A.TASK + 1) == 11
    monkeypatch.setattr(adapters, "tasks_for", lambda spark, rows: rows // 1000)
    monkeypatch.setattr(queries, "tasks_for", lambda spark, rows: rows // 1000)
    n = adapters.event_tasks(spark, SF)
    assert n >= 10
    assert adapters.event_base(spark, SF).rdd.getNumPartitions() == n
    assert queries.QUERIES["factor_rsrs"](spark, SF).rdd.getNumPartitions() == n
    assert queries.QUERIES["factor_amp_slice"](spark, SF).rdd.getNumPartitions() == 6
    assert queries._ts(spark, SF).rdd.getNumPartitions() == 6
    panel = adapters.panel(spark, SF)
    assert E.cs_ic(panel, queries.PAIRS, queries.AT, "security_id", 9).rdd.getNumPartitions() == 9


def test_as_of_takes_a_number_of_tasks(spark):
    times = spark.sql("select 1 as s, timestamp_ntz'2024-01-01 00:00:00' as ts, 5 as v")
    out = I.as_of(times.select("s", F.col("ts").alias("grid_ts")), times, ["s"], "grid_ts", "ts", tasks=7)
    assert out.rdd.getNumPartitions() == 7 and [r.v for r in out.collect()] == [5]
