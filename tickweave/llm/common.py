"""What the operators of this subpackage share: reading, checkpoints, ranks without a hot window."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One in fewer splits than there are cores (a small table in one file) is dealt out to all of them: a matter of layout alone,
    no operator's result or method hangs on it, and a table of more splits is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a session on one machine (tests) may name none: it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def partitions_for(rows: int, each: int) -> int:
    """Partitions of about `each` rows."""
    return max(1, math.ceil(rows / each))


def in_fewer(df: DataFrame, each: int) -> DataFrame:
    """A checkpointed df in partitions of about `each` rows, if it has more than that takes: a small table is then grouped and joined without exchanges of nearly empty parts."""
    return df.coalesce(partitions_for(df.count(), each))


BATCH_ROWS, BATCH_BYTES = 2_000, 1_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand texts to Python in batches of bounded size, so that a worker's memory doesn't follow the length of its texts.

    These settings are read when a plan runs, so they stay set in the session: larger ones are lowered, smaller ones are left.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(f"spark.sql.execution.arrow.{key}")).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def span_text(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def byte_runs(sizes: list[int], limit: int) -> Iterator[range]:
    """Runs of neighbouring rows whose sizes add up to about `limit`, one row at least: what a task works on at once."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield range(begin, k)
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield range(begin, len(sizes))


def bucketed_prefix(
    df: DataFrame, groups: list[str], bucket: str, order: list[Column], weight: str | None, out: str
) -> DataFrame:
    """Add `out`: the sum of `weight` (None: the number of rows) over the rows before this one in its group.

    Rows of a group are ordered by (bucket, order). No window holds a whole group: sums of the buckets
    are aggregated (map-side combined), turned into offsets, and only the rows of one
    (group, bucket) meet in a window. The bucket table has groups x buckets rows.
    """
    value = F.col(weight) if weight else F.lit(1)
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_bucket_sum"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*groups, bucket])],
        F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_offset"),
    )
    matched = [df[c].eqNullSafe(offsets[f"_k{i}"]) for i, c in enumerate([*groups, bucket])]
    condition = matched[0]
    for m in matched[1:]:
        condition = condition & m
    within = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(offsets, condition, "left")
    running = F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(out, (F.col("_offset") + running).cast("long")).drop(
        *[f"_k{i}" for i in range(len(groups) + 1)], "_offset"
    )
