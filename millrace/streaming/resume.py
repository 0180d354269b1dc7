"""Scoring that resumes: a file stream whose checkpoint knows what was scored, and a sink that is idempotent by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def resume_scoring(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score every new file of a Parquet folder once. A batch that is repeated after a failure writes its own folder again."""
    rows = spark.readStream.schema(schema).parquet(source)

    def sink(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, out: str, id_: str = "id") -> DataFrame:
    """Everything scored so far, one row an id."""
    return spark.read.parquet(out).drop("batch").dropDuplicates([id_])
