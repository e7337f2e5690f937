"""Tables with a record of commits: replaced days, empty tables, killed and crossing writers."""

import pytest

from tickweave.sources.readers import read_table
from tickweave.sources.sinks import Files, last_record, read_committed, write_table

DAYS = "date string, k int, v double"


def rows(spark, root, name="t"):
    return sorted(tuple(r) for r in read_table(spark, root, name).select("k", "v", "date").collect())


def test_days_are_replaced_with_what_they_have_now(spark, tmp_path):
    root = str(tmp_path)
    write_table(spark.createDataFrame([("d1", 1, 1.0), ("d2", 2, 2.0), ("d3", 3, 3.0)], DAYS), root, "t")
    write_table(spark.createDataFrame([("d2", 9, 9.0), ("d9", 7, 7.0)], DAYS), root, "t", covers=["d2", "d3"])  # d3 has no rows now; d9 isn't covered
    assert rows(spark, root) == [(1, 1.0, "d1"), (9, 9.0, "d2")]
    assert read_table(spark, root, "t", ["d2"]).count() == 1 and read_table(spark, root, "t", ["d3"]).count() == 0
    write_table(spark.createDataFrame([("d3", 4, 4.0)], DAYS), root, "t", covers=["d3"])
    write_table(spark.createDataFrame([("d1", 5, 5.0)], DAYS), root, "t", covers=["d1"])
    assert rows(spark, root) == [(4, 4.0, "d3"), (5, 5.0, "d1"), (9, 9.0, "d2")]
    write_table(spark.createDataFrame([("d1", 6, 6.0)], DAYS), root, "t")  # without covers: the whole table
    assert rows(spark, root) == [(6, 6.0, "d1")] and len(last_record(spark, root, "t").parts) == 1


def test_folders_of_replaced_days_are_pruned(spark, tmp_path):
    root = str(tmp_path)
    write_table(spark.createDataFrame([(f"d{i}", i, 1.0) for i in range(5)], DAYS), root, "t")
    write_table(spark.createDataFrame([], DAYS), root, "t", covers=["d1", "d2"])
    assert len({f.rsplit("date=")[1][:2] for f in read_table(spark, root, "t").inputFiles()}) >= 3 and rows(spark, root) == [(0, 1.0, "d0"), (3, 1.0, "d3"), (4, 1.0, "d4")]
    plan = read_table(spark, root, "t", ["d3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan


def test_a_table_without_rows(spark, tmp_path):
    root = str(tmp_path)
    for k, name in ((["date"], "a"), ([], "b")):
        write_table(spark.createDataFrame([], DAYS), root, name, k)
        got = read_table(spark, root, name)
        assert got.count() == 0 and dict(got.dtypes) == {"date": "string", "k": "int", "v": "double"}
    with pytest.raises(FileNotFoundError):
        read_table(spark, root, "none")


def test_a_killed_writer_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path)
    write_table(spark.createDataFrame([("d1", 1, 1.0)], DAYS), root, "t")
    # killed before its record, and in the middle of one
    spark.createDataFrame([(8, 8.0)], "k int, v double").write.parquet(f"{root}/t/data/commit=2/date=d1")
    Files(spark, f"{root}/t").write("staged-x", "{")
    assert rows(spark, root) == [(1, 1.0, "d1")]
    Files(spark, f"{root}/t").write("commits/2.json", '{"schema": {')
    assert rows(spark, root) == [(1, 1.0, "d1")] and last_record(spark, root, "t").number == 1
    with pytest.raises(RuntimeError):  # the number is taken: whoever took it may still be at work
        write_table(spark.createDataFrame([("d2", 2, 2.0)], DAYS), root, "t", covers=["d2"])
    assert rows(spark, root) == [(1, 1.0, "d1")]
    Files(spark, f"{root}/t").remove("commits/2.json")
    write_table(spark.createDataFrame([("d2", 2, 2.0)], DAYS), root, "t", covers=["d2"])
    assert rows(spark, root) == [(1, 1.0, "d1"), (2, 2.0, "d2")]


def test_columns_come_and_stay(spark, tmp_path):
    root = str(tmp_path)
    write_table(spark.createDataFrame([("d1", 1, 1.0)], DAYS), root, "t")
    write_table(spark.createDataFrame([("d2", 2, "x")], "date string, k int, w string"), root, "t", covers=["d2"])
    assert sorted((r.date, r.k, r.v, r.w) for r in read_committed(spark, root, "t").collect()) == [("d1", 1, 1.0, None), ("d2", 2, None, "x")]
    with pytest.raises(ValueError, match="type"):
        write_table(spark.createDataFrame([("d3", "no")], "date string, k string"), root, "t", covers=["d3"])
    assert read_committed(spark, root, "t").count() == 2


def test_old_commits_go_one_later(spark, tmp_path):
    root = str(tmp_path)
    files = Files(spark, f"{root}/t")
    for k in range(4):
        held = read_table(spark, root, "t") if k else None
        write_table(spark.createDataFrame([("d1", k, 1.0)], DAYS), root, "t")
        if held is not None:
            assert held.count() == 1  # a reader of the table before is not cut off
    assert files.names("data") == ["commit=3", "commit=4"]
