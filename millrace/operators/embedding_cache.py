"""Vectors of texts, encoded once each: an append-only table keyed by content."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near import materialised, shared_folder
from .ranks import placed

CACHE = "key string, vector array<float>"


def content_key(text: str = "text") -> F.Column:
    return F.sha2(text, 256)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(key, vector) of everything encoded so far; an interrupted wave that was written twice counts once."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).dropDuplicates(["key"])


def encode_missing(texts: DataFrame, folder: str, encode: Callable[[list[str]], np.ndarray], wave: int = 1_000_000, padded: int = 1 << 20, most: int = 512) -> int:
    """Encodes the distinct texts that the cache lacks; returns how many.

    Missing texts are placed in order of length over the whole table and dealt into waves; a wave is one append, all or
    nothing, so that a run that is lost repeats the wave it was in and no other. Inside a task, texts come in that order, and a
    batch ends at `most` texts or where texts times the longest one's characters would pass `padded`. encode gives a
    finite matrix with a row a text, or the job fails. Null texts have no vector.
    """
    spark = texts.sparkSession
    wanted = texts.where("text IS NOT NULL").select("text", content_key().alias("key"))
    keys = wanted.groupBy("key").agg(F.first(F.length("text")).alias("size")).join(cached(spark, folder).select("key"), "key", "left_anti")
    # places go by keys alone; a text is dealt once, to its key
    order = materialised(placed(keys, "size", "key").select("key", "size", F.floor(F.col("place") / wave).alias("wave")))
    if order.isEmpty():
        return 0
    ordered = wanted.join(order, "key").dropDuplicates(["key"])
    # each wave reads its own folder
    beside = f"{shared_folder(spark)}/waves-{uuid.uuid4().hex}"
    ordered.select("text", "key", "size", "wave").write.partitionBy("wave").parquet(beside)
    rows = spark.read.schema("text string, key string, size int, wave long").parquet(beside)
    waves = sorted(r["wave"] for r in rows.select("wave").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, lo = batch.column(0), batch.column(1).to_pylist(), 0
            while lo < len(values):
                hi, longest = lo, 0
                while hi < len(values) and hi - lo < most:
                    longest = max(longest, len(values[hi]), 1)
                    if hi > lo and (hi - lo + 1) * longest > padded:
                        break
                    hi += 1
                vectors = np.asarray(encode(values[lo:hi]), np.float32)
                if vectors.shape[0] != hi - lo or not np.isfinite(vectors).all():
                    raise ValueError("the encoder must give a finite row for every text")
                lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), lists], ["key", "vector"])
                lo = hi

    done = 0
    for k in waves:
        part = rows.where(F.col("wave") == k)
        part.repartitionByRange("size", "key").sortWithinPartitions("size", "key").select("key", "text").mapInArrow(run, CACHE).write.mode("append").parquet(folder)
        done += part.count()
    return done


def embedded(texts: DataFrame, folder: str) -> DataFrame:
    """The rows with their vectors; a text that is not in the cache has none."""
    own = texts.withColumn("__own", content_key())  # so that the text itself need not be dealt
    return own.join(cached(texts.sparkSession, folder).withColumnRenamed("key", "__key"), F.col("__own") == F.col("__key"), "left").drop("__key", "__own")
