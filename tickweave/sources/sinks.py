"""Sinks (OP-09 to OP-12): tables whose days are replaced by a record of commits.

A table is a folder with `data/commit=N/[day folders]` and `commits/N.json`. A write fills a new commit folder, which nobody reads yet, and then puts its record in
place by one rename: until then the table is what it was, whole, and a job killed midway leaves a folder that the next write of that number clears. The record holds the table's
schema, so a table without rows can be read, and for each commit still in use which values of the partition column it covers - the days that a
stage computed, whether or not they have rows. A later commit hides those values in earlier ones, so a day that now has no rows has none.

One writer at a time for a table: a second one finds its number taken and is refused. Readers take the last complete record.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few calls on Hadoop's file system that the record needs; works for every store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        path = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        return not self.fs.exists(self.path(to)) and self.fs.rename(self.path(name), self.path(to))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Record:
    """What a table is made of. parts: (commit, values it covers, or None for all), in order; each hides what it covers in those before."""

    number: int
    schema: T.StructType
    partition: str | None
    parts: list[tuple[int, list[str] | None]]

    def hidden(self, k: int) -> list[str]:
        """Values of the k-th part that later ones have replaced."""
        return sorted({v for _, values in self.parts[k + 1 :] for v in values or []})


def last_record(spark: SparkSession, root: str, name: str, number: int | None = None) -> Record | None:
    """The last complete record (or the one of that number); None where no table is."""
    files = Files(spark, f"{root}/{name}")
    numbers = sorted((int(n.removesuffix(".json")) for n in files.names("commits") if n.removesuffix(".json").isdigit()), reverse=True)
    for n in numbers if number is None else [number]:
        try:
            found = json.loads(files.read(f"commits/{n}.json"))
        except ValueError:  # a record that a store without renames left half written
            continue
        return Record(n, T.StructType.fromJson(found["schema"]), found["partition"], [(c, v) for c, v in found["parts"]])
    return None


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """All columns of both; a name that changes its type is refused."""
    kinds = {f.name: f.dataType for f in old}
    clash = [f.name for f in new if kinds.get(f.name, f.dataType) != f.dataType]
    if clash:
        raise ValueError(f"columns that change their type: {clash}")
    return T.StructType([*old.fields, *[f for f in new if f.name not in kinds]])


def _optional(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def write_table(df: DataFrame, root: str, name: str, partition: list[str] | None = None, covers: list[str] | None = None) -> None:
    """Replace root/name: the values of the partition column (date, if there is one) that `covers` lists, whether df has rows of them or not; all by default."""
    spark = df.sparkSession
    keys = [c for c in (["date"] if partition is None else partition) if c in df.columns]
    if len(keys) > 1:
        raise ValueError("one partition column at most")
    key = keys[0] if keys else None
    if key:
        df = df.withColumn(key, F.col(key).cast("string"))
    if covers is not None and key:
        covers = sorted(set(covers))
        df = df.filter(F.col(key).isin(covers))
    before, schema = last_record(spark, root, name), _optional(df.schema)
    whole = covers is None or key is None or before is None or before.partition != key
    n = before.number + 1 if before else 1
    files = Files(spark, f"{root}/{name}")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(key) if key else writer).parquet(f"{root}/{name}/data/commit={n}")
    parts = [(n, covers if key else None)]
    if not whole:
        kept = [(c, v) for c, v in before.parts if v is None or not set(v) <= set(covers)]
        parts, schema = [*kept, *parts], _merged(before.schema, schema)
    record = {"schema": schema.jsonValue(), "partition": key, "parts": parts}
    staged = f"staged-{uuid.uuid4().hex}"
    files.write(staged, json.dumps(record))
    files.fs.mkdirs(files.path("commits"))
    if not files.rename(staged, f"commits/{n}.json"):
        files.remove(staged)
        raise RuntimeError(f"{root}/{name}: another writer has made commit {n}")
    if before:
        _clear(files, {c for c, _ in parts} | {c for c, _ in before.parts})


def _clear(files: Files, used: set[int]) -> None:
    """Remove commit folders that neither the last record nor the one before it uses."""
    for folder in files.names("data"):
        if folder.startswith("commit=") and int(folder.removeprefix("commit=")) not in used:
            files.remove(f"data/{folder}")


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as its last record has it; the partition column is a string. Replaced days are pruned with their folders."""
    record = last_record(spark, root, name)
    if record is None:
        raise FileNotFoundError(f"no table {root}/{name}")
    data = f"{root}/{name}/data"
    schema = T.StructType([*record.schema.fields, T.StructField("commit", T.IntegerType())])
    df = spark.read.schema(schema).option("basePath", data).parquet(*[f"{data}/commit={c}" for c, _ in record.parts])
    shown = None
    for k, (commit, _) in enumerate(record.parts):
        own = F.col("commit") == commit
        if record.partition and (gone := record.hidden(k)):
            own = own & (F.col(record.partition).isNull() | ~F.col(record.partition).isin(gone))
        shown = own if shown is None else shown | own
    return df.filter(shown).select(*record.schema.names)


def export_csv(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition) if partition else writer).csv(path)
