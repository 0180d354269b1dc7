"""Checks of predictions before they are scored or published, and probabilities in the order of the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import log_softmax


def _endless(z: Column) -> Column:
    return z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))


def publication_issues(predictions: DataFrame, partition: DataFrame, key: str, status: str, legal: list[str]) -> DataFrame:
    """(code, n) of predictions against the ids of a partition: duplicate, illegal, missing, unknown.

    duplicate counts rows beyond an id's first, illegal rows whose status is null or none of `legal`, missing ids
    without a prediction, unknown ids outside the partition. One shuffle by id serves all four. Empty tables give
    zeros; a null id is unknown.
    """
    ill = ~F.coalesce(F.col(status).isin(legal), F.lit(False))
    given = predictions.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias("__n"), F.count_if(ill).alias("__ill"))
    owed = partition.select(F.col(key).alias("__owed")).distinct()
    both = given.join(owed, F.col("__id") == F.col("__owed"), "full_outer")
    n = F.col("__n")
    counts = both.agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate"), F.coalesce(F.sum("__ill"), F.lit(0)).alias("illegal"),
        F.count_if(n.isNull()).alias("missing"), F.count_if(n.isNotNull() & F.col("__owed").isNull()).alias("unknown"),
    )
    return counts.unpivot([], ["duplicate", "illegal", "missing", "unknown"], "code", "n")


def shape_error(logits: Column, candidates: Column, eligible: Column) -> Column:
    """absent (null logits of an eligible row), width, finite, or null for a sound prediction."""
    return F.when(logits.isNull(), F.when(eligible, "absent")).when(F.size(logits) != candidates, "width").when(F.exists(logits, _endless), "finite")


def label_probs(labels: Column, ranking: Column) -> Column:
    """(error, probs) from distinct labels in order of the request and a ranking of (label, score) in any order.

    error is missing, duplicate, unknown or non-finite, the first that holds; probs is then null.
    """
    hits = F.transform(labels, lambda w: F.transform(F.filter(ranking, lambda r: r["label"] == w), lambda r: r["score"]))
    error = (
        F.when(F.exists(hits, lambda h: F.size(h) == 0), "missing").when(F.exists(hits, lambda h: F.size(h) > 1), "duplicate")
        .when(F.size(ranking) > F.size(labels), "unknown").when(F.exists(F.flatten(hits), _endless), "non-finite")
    )
    probs = F.transform(log_softmax(F.flatten(hits)), F.exp)
    return F.struct(error.alias("error"), F.when(error.isNull(), probs).alias("probs"))
