"""Sources (OP-01 to OP-08): raw snapshot files, pipeline tables, override lists and factor metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.exprs import number
from tickweave.sources.schemas import BOOK, METADATA, NEEDED, RAW_COLUMNS
from tickweave.sources.sinks import read_committed


def raw_paths(root: str, days: list[str] | None = None) -> list[str]:
    return [f"{root}/{d}" for d in days] if days else [f"{root}/*"]


def read_raw(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """Raw snapshots under root/yyyymmdd/secid.csv -> typed ticks of both markets. A file is one string on its way, so it has to fit one (2 GB)."""
    files = spark.read.text(raw_paths(root, days), wholetext=True)
    return parse_raw(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def list_raw(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """(day, security_id, bytes) of the files there are: a listing, no content is read.

    Spark's scans leave out files of no bytes; the names of all files, which its listing has anyway, tell them.
    """
    found = spark.read.format("binaryFile").load(raw_paths(root, days))
    there = listed(found.select("path", F.col("length").alias("bytes")))
    every = listed(spark.createDataFrame([(n,) for n in found.inputFiles()], "path string").withColumn("bytes", F.lit(0).cast("long"))).drop("bytes")
    return every.join(there, ["day", "security_id"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))


def listed(files: DataFrame) -> DataFrame:
    """files (path, bytes) -> (day, security_id, bytes) of those that are raw files."""
    name, day = _placed()
    return files.filter(_is_raw()).select(day.alias("day"), F.regexp_replace(name, r"\.csv$", "").alias("security_id"), "bytes")


def _placed() -> tuple[Column, Column]:
    """File name and folder of `path`."""
    return F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)


def _is_raw() -> Column:
    name, day = _placed()
    return name.endswith(".csv") & ~name.startswith("_") & day.rlike(r"^\d{8}$")


#: Commas that no quotes hold.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    plain = F.transform(F.split(line, COMMA, -1), lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), plain).otherwise(F.split(line, ",", -1))


def parse_raw(files: DataFrame) -> DataFrame:
    """files (path, content), a row for each stock and day -> typed ticks (OP-01 to OP-05, OP-20); other files and sidecars (`_...`) are left out.

    Columns are found by name in each file's own header (its first line with UpdateTime, or its first line), so files of both dialects and any order of
    columns can lie side by side, without a join: a file is one row until its lines are told apart. day and security_id come from the path, so ids
    keep their zeros; file_line counts the file's lines. lacks: the first column that the header has not and a later stage needs; nothing raises.
    """
    name, day = _placed()
    named = files.filter(_is_raw()).select(name.alias("name"), day.alias("day"), F.split("content", r"\r?\n", -1).alias("lines"))
    of_time, filled = lambda x: F.contains(x, F.lit("UpdateTime")), lambda x: F.trim(x) != ""
    head = F.coalesce(F.get(F.filter("lines", of_time), 0), F.get(F.filter("lines", filled), 0))
    named = named.withColumn("head", head)
    headed = named.withColumns({"header": F.transform(_cells(F.regexp_replace("head", "^\ufeff", "")), lambda c: F.trim(c)), "head_at": F.array_position("lines", F.col("head")) - 1})
    places = F.struct(*[(F.array_position("header", c).cast("int") - 1).alias(c) for c in RAW_COLUMNS])
    lacks = F.get(F.filter(F.array(*map(F.lit, NEEDED)), lambda c: ~F.array_contains("header", c)), 0)
    each = headed.select("day", "name", "head_at", lacks.alias("lacks"), places.alias("at"), F.posexplode("lines").alias("file_line", "line"))
    rows = each.filter(filled(F.col("line")) & ~of_time(F.col("line")) & (F.col("file_line") != F.col("head_at"))).withColumn("cells", _cells(F.col("line")))
    text = lambda c: F.nullif(F.trim(F.get("cells", F.col(f"at.{c}"))), F.lit(""))
    there = lambda c: F.col(f"at.{c}") >= 0
    return rows.select(
        "day", F.regexp_replace("name", r"\.csv$", "").alias("security_id"), F.col("file_line").cast("long"), text("Date").alias("Date"), text("UpdateTime").alias("UpdateTime"),
        *[number(text(c)).alias(c) for c in ("PreCloPrice", "LastPrice", "Turnover")],
        number(F.coalesce(text("TradVolume"), text("Volume"))).alias("volume"),
        F.coalesce(text("InstruStatus"), text("TradingPhaseCode")).alias("status"),
        F.when(there("InstruStatus"), "SH").when(there("TradingPhaseCode"), "SZ").otherwise("UNK").alias("market"),
        *[number(text(c)).alias(c) for c in BOOK], "lacks",
    )


def read_table(spark: SparkSession, root: str, name: str, days: list[str] | None = None) -> DataFrame:
    """A pipeline table as its last commit left it, pruned to days if it is partitioned by date."""
    df = read_committed(spark, root, name)
    return df.filter(F.col("date").isin(days)) if days and "date" in df.columns else df


def available_days(df: DataFrame) -> DataFrame:
    """OP-01, OP-79: the days there are, sorted."""
    return df.select("date").distinct().orderBy("date")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """OP-07: lines Date,SecurityID[,Reason]; blank lines, comments and the header don't count."""
    parts = F.split("line", ",")
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    rows = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("Date") & (F.size(parts) >= 2))
    return rows.select(F.trim(parts[0]).alias("day"), F.trim(parts[1]).alias("security"), F.trim(F.try_element_at(parts, F.lit(3))).alias("reason"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """OP-08: the factors' descriptions, with quoted fields over several lines."""
    return spark.read.schema(METADATA).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_factor_stats(spark: SparkSession, root: str) -> DataFrame:
    """OP-06: the statistics of all factors, with factor_name from the partition."""
    return read_committed(spark, root, "cs_ic_stats")
