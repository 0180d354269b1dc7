"""Typed questions: candidates, constraints, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import state_text
from .scoring import confidence, expected, first_best, log_softmax


def candidates(kind: Column, criteria: Column) -> Column:
    """array<struct<key, text>>: choices by key (the key where the text is empty), levels by place, or false and true.

    criteria: array<struct<key, text>>, ignored for yes/no questions without it.
    """
    choice = F.transform(criteria, lambda c: F.struct(c["key"].alias("key"), F.coalesce(F.nullif(F.trim(c["text"]), F.lit("")), c["key"]).alias("text")))
    score = F.transform(criteria, lambda c, i: F.struct(i.cast("string").alias("key"), c["text"].alias("text")))
    default = F.array(F.struct(F.lit("false").alias("key"), F.lit("No, this is false.").alias("text")), F.struct(F.lit("true").alias("key"), F.lit("Yes, this is true.").alias("text")))
    return F.when(kind == "choice", choice).when(kind == "score", score).otherwise(F.coalesce(criteria, default))


def candidate_error(texts: Column) -> Column:
    """What is wrong with a list of candidates; null if nothing is."""
    n = F.size(texts)
    return F.when(n < 2, "too few").when(n > 64, "too many").when(F.exists(texts, lambda x: F.trim(x) == ""), "empty").when(F.size(F.array_distinct(texts)) < n, "repeated")


def answer(kind: Column, keys: Column, logits: Column, temperature: float = 1.0) -> Column:
    """struct<label, value, confidence>: the best key, P(true) or expected level, and how far the best stands out."""
    p = F.transform(log_softmax(logits, temperature), F.exp)
    label = F.get(keys, first_best(logits))
    levels = F.transform(keys, lambda k, i: i.cast("double"))
    value = F.when(kind == "choice", F.array_max(p)).when(kind == "score", expected(p, levels)).otherwise(F.get(p, F.array_position(keys, "true").cast("int") - 1))
    decided = F.when(kind == "noul", F.when(value >= 0.5, "true").otherwise("false")).otherwise(label)
    return F.struct(decided.alias("label"), value.alias("value"), confidence(p).alias("confidence"))


def stable_rank(rows: DataFrame, by: str, score: str, place: str) -> DataFrame:
    """Descending score, then place."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), place)))


def pairs(rows: DataFrame, id_: str) -> DataFrame:
    """(id, qid, state_text, key, text, place) from (id, state, questions: array<struct<qid, kind, instructions, criteria>>).

    The state text is the state and the question's instructions, with a blank line between where both have text.
    """
    q = rows.select(id_, "state", F.explode("questions").alias("q"))
    found = q.select(id_, F.col("q.qid").alias("qid"), state_text(F.col("state"), F.col("q.instructions")).alias("state_text"), candidates(F.col("q.kind"), F.col("q.criteria")).alias("c"))
    return found.select(id_, "qid", "state_text", F.posexplode("c").alias("place", "c")).select(id_, "qid", "state_text", "c.key", "c.text", "place")


def served(kind: Column, keys: Column, logits: Column, yes: Column, temperature: float) -> Column:
    """struct<choice, value, probabilities>: a choice's best key, a score's expected level, or the chance of the key at `yes`."""
    p = F.transform(log_softmax(logits, temperature), F.exp)
    levels = F.transform(keys, lambda k, i: i.cast("double"))
    value = F.when(kind == "score", expected(p, levels)).when(kind == "noul", F.get(p, yes))
    return F.struct(F.when(kind == "choice", F.get(keys, first_best(logits))).alias("choice"), value.alias("value"), F.when(kind != "noul", p).alias("probabilities"))
