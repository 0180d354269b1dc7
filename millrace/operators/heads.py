"""Scoring heads with weights from a table: limits first, then blocks of matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Numbers of a head that every worker may hold (8 bytes each).
MOST_WEIGHTS = 4_000_000
SEPARATOR = "\n\nCandidate action:\n"


def head_weights(table: DataFrame, most: int = MOST_WEIGHTS) -> dict[str, np.ndarray]:
    """Matrices by name from (name, i, j, value); ValueError if there are more than `most` numbers, a gap or a number that is not finite."""
    n = table.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a head of more than {most} numbers is not sent to every worker")
    out = {}
    rows = table.select("name", F.col("i").cast("int"), F.col("j").cast("int"), F.col("value").cast("double")).toPandas()
    for name, x in rows.groupby("name"):
        m = np.full((x.i.max() + 1, x.j.max() + 1), np.nan)
        m[x.i, x.j] = x.value
        if not np.isfinite(m).all() or len(x) != m.size:
            raise ValueError(f"{name} is not a whole finite matrix")
        out[name] = m
    return out


_erf = np.frompyfunc(erf, 1, 1)


def scalar_head(x: np.ndarray, w: dict[str, np.ndarray], eps: float = 1e-5) -> np.ndarray:
    """A score a row: layer norm (gain, bias), a linear layer (w1, b1), GELU, a linear layer (w2, b2)."""
    centred = x - x.mean(1, keepdims=True)
    z = centred / np.sqrt((centred**2).mean(1, keepdims=True) + eps) * w["gain"][0] + w["bias"][0]
    h = z @ w["w1"].T + w["b1"][0]
    h = 0.5 * h * (1 + _erf(h / 2**0.5).astype(float))
    return (h @ w["w2"].T + w["b2"][0])[:, 0]


def projected_cosine(state: np.ndarray, action: np.ndarray, w: dict[str, np.ndarray], clamp: float = 100.0) -> np.ndarray:
    """A score a row: both sides to unit length, through their projection, to unit length; the cosine times exp(log_scale), at most `clamp`."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s, a = unit(unit(state) @ w["state"].T), unit(unit(action) @ w["action"].T)
    return (s * a).sum(1) * min(float(np.exp(w["log_scale"][0, 0])), clamp)


def request_error(state: Column, texts: Column, tokens: Callable[[Column], Column], state_limit: int, candidate_limit: int, joint_limit: int, state_tokens: Column | None = None, joint_tokens: Callable[[Column], Column] | None = None) -> Column:
    """Why a request is not scored, by the first rule it breaks; null if it is. tokens: the count of a text's tokens, as a column.

    state_tokens and joint_tokens (of a candidate): the same counts where they are known, or cheaper than by counting whole joint texts.
    """
    n = F.coalesce(F.size(texts), F.lit(0))
    joint = joint_tokens or (lambda x: tokens(F.concat(state, F.lit(SEPARATOR), x)))
    return (
        F.when(n < 2, "too few candidates").when(n > 64, "too many candidates")
        .when(F.exists(texts, lambda x: x.isNull() | (F.trim(x) == "")), "empty candidate")
        .when(F.size(F.array_distinct(texts)) < n, "repeated candidate")
        .when(state.isNull() | (F.trim(state) == ""), "empty state")
        .when((tokens(state) if state_tokens is None else state_tokens) > state_limit, "long state")
        .when(F.exists(texts, lambda x: tokens(x) > candidate_limit), "long candidate")
        .when(F.exists(texts, lambda x: joint(x) > joint_limit), "long joint input")
    )


def rank_joint(requests: DataFrame, encode: Callable[[list[str]], np.ndarray], weights: dict[str, np.ndarray], error: Column, rows: int = 512) -> DataFrame:
    """(id, place, key, score, rank, reason) from requests (id, state, candidates: array<struct<key, text>>).

    A request that breaks a rule has one row with its reason and no score: all its candidates are checked before any is
    scored, and nothing is cut. Each candidate is scored by itself, on the whole joint text; equal scores keep their order.
    """
    checked = requests.withColumn("reason", error)
    pairs = checked.where("reason IS NULL").select("id", F.posexplode("candidates").alias("place", "c"), "state").select("id", "place", "c.key", F.concat("state", F.lit(SEPARATOR), "c.text").alias("joint"))
    sent = requests.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(scalar_head(np.asarray(encode(part.column(3).to_pylist()), float), sent.value))], ["id", "place", "key", "score"])

    scored = pairs.mapInArrow(run, f"id {requests.schema['id'].dataType.simpleString()}, place int, key string, score double")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "place"))).withColumn("reason", F.lit(None).cast("string"))
    none = lambda t: F.lit(None).cast(t)
    return ranked.union(checked.where("reason IS NOT NULL").select("id", none("int"), none("string"), none("double"), none("int"), "reason"))


def candidate_loss(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, loss, rows): mean cross-entropy of `target` among each row's own `scores` (array); a missing candidate has no share."""
    scores = F.filter("scores", lambda x: x.isNotNull())
    top = F.array_max(scores)
    total = F.log(F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) + top
    loss = F.when(F.get("scores", F.col("target")).isNotNull(), total - F.get("scores", F.col("target")))
    return rows.withColumn("__loss", loss).groupBy(*group).agg(F.avg("__loss").alias("loss"), F.count("__loss").alias("rows"))
