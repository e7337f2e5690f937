"""From documents to packed training sequences: five stages, each by one operator of tickweave.llm.

STAGES lists them as (name, function); a function takes (spark, docs, sf_dir), docs with the columns of `documents`, and works on
all rows. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, shared_folder, table
from tickweave.llm.langid import UNKNOWN, predict, train
from tickweave.llm.mixing import deal, first_words, mix
from tickweave.llm.packing import pack, token_pieces
from tickweave.llm.secrets import find_secrets, redact
from tickweave.llm.similar import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 1.2  # times an even guess among the languages learnt: a score below is no better than a guess; one language alone leaves nothing to guess


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those whose language is a guess; a missing lang is filled in. With one language, or without any labelled row, all documents with letters stay."""
    docs = docs.select(*COLUMNS)
    model = train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs, model)
    least = LEAST_SCORE / len(model.languages) if len(model.languages) > 1 else 0.0
    kept = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more on five-word shingles, in chains) stays: the one of least doc_id.

    Rows that repeat the doc_id of a document that stays count as copies of it; documents without a doc_id name no group and stay.
    """
    docs = docs.select(*COLUMNS)
    stay = similar_documents(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    stay = checkpointed(stay.withColumnRenamed("doc_id", "of"))
    once = docs.join(stay.filter("n = 1"), F.col("doc_id") == F.col("of"), "left_semi")
    repeated = docs.join(stay.filter("n > 1"), F.col("doc_id") == F.col("of"), "left_semi").dropDuplicates(["doc_id"])
    return once.union(repeated).union(docs.filter("doc_id is null")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to its kind in brackets; no document goes."""
    clean = redact(find_secrets(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: documents come as often as they are dealt; one that the budget cuts keeps its first words."""
    dealt = mix(deal(docs.select(*COLUMNS)))
    part = F.col("take") < F.col("size")
    text = F.when(part, first_words(F.when(part, F.col("text")), F.col("take"))).otherwise(F.col("text"))
    cut = dealt.withColumn("text", text)
    return cut.withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    packed = pack(checkpointed(token_pieces(docs)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, the classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared checkpoint folder and read again. A stage's table goes once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are checkpointed by now
    _remove(spark, folder)
    return packed


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
