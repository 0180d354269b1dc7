"""From documents to token records: quality, near duplicates, benchmark passages, mixing, binary output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, documents
from millrace.llm.decontaminate import leaks
from millrace.llm.mixing import mixed_documents
from millrace.llm.near_dup import surplus
from millrace.llm.quality import filter_quality
from millrace.llm.queries import BYTE_BPE
from millrace.llm.token_output import token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, with all columns; repeated rows stay or go together.

    Null and empty texts are scored as such. Without a usable label nothing can be learned, and all documents stay.
    """
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id.

    Documents without words or doc_id have no duplicates and stay. A document is a doc_id with a text: rows alike in
    both stay together, and of two texts with one doc_id each is judged by itself. An empty table gives no rows.
    """
    gone = surplus(docs).select(F.col("doc_id").alias("__doc"), F.col("k").alias("__k"))
    return docs.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__k")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. A document is a doc_id (null is one too) with a text: each is judged by its own text.

    Null and empty texts hold no passage and stay; rows alike in both stay or go together. An empty table gives no rows.
    """
    scratch = Scratch(spark, "leak-stage")
    gone = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__doc"), F.col("k").alias("__k")).distinct()
    gone = scratch.table(gone, "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__k")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them (0 to 3 times); those without words (null texts too) once."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records of all documents that are left, written and read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; a null doc_id comes first; repeated rows each have a record.
    """
    return token_output(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: SQL expresses neither the classifier nor the tokenizer: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
