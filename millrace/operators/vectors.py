"""Embeddings as arrays: norms, cosines, nearest of all, contrastive loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    # the norm is bound once, as the only element of an array
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def _packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of about `rows` vectors as (ids, flat values) arrays."""
    n = vectors.count()
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // rows))))
    block = vectors.where("embedding IS NOT NULL").groupBy(part.alias("part")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("x"))
    return block.select(F.transform("x", lambda v: v["vec_id"]).alias(f"{name}_ids"), F.flatten(F.transform("x", lambda v: v["embedding"].cast("array<double>"))).alias(name))


def _best(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, ids, cosines): the k nearest of y (ids b) for each of x (ids a), ties by id; `rows` queries at a time, so that no more cosines are held."""
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(y, axis=1)[None, :]
        for lo in range(0, len(a), rows):
            ids, part = a[lo : lo + rows], x[lo : lo + rows]
            cosine = np.round((part @ y.T) / np.linalg.norm(part, axis=1)[:, None] / norms, 6)
            cosine[(ids[:, None] == b[None, :]) | ~np.isfinite(cosine)] = -2
            least = np.partition(cosine, -min(k, len(b)), axis=1)[:, -min(k, len(b)), None]
            i, j = np.nonzero((cosine >= least) & (cosine > -2))  # the k best and what ties with the last of them
            near = cosine[i, j]
            order = np.lexsort((b[j], -near, i))
            i, j, near = i[order], j[order], near[order]
            some = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield ids[i[some]], b[j[some]], near[some]


def nearest_to(vectors: DataFrame, queries: DataFrame, k: int, temperature: float = 0.07, block: int = 2000) -> DataFrame:
    """(query, vec_id, cosine, score, rank): the k nearest of all vectors for each of a stated set of queries.

    Exact: every block of queries meets every block of vectors, and only the k best of a block pair leave it. Blocks have
    a bounded number of rows. Vectors without a direction (null, all zero) are nobody's neighbour.
    """
    both = _packed(queries, block, "q").crossJoin(_packed(vectors, block, "v"))

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for q_ids, q, v_ids, v in zip(*(batch.column(c) for c in range(4))):
            a, b = (np.asarray(i.values) for i in (q_ids, v_ids))
            x, y = (np.asarray(m.values).reshape(len(i), -1) for m, i in ((q, a), (v, b)))
            yield from (pa.RecordBatch.from_arrays([*map(pa.array, found)], ["query", "vec_id", "cosine"]) for found in _best(a, x, b, y, k))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from blocks(batch)
            del batch  # else it is held while the next one is read

    found = both.mapInArrow(search, "query long, vec_id long, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round(F.col("cosine") / temperature, 4))


def contrastive_loss(rows: DataFrame, batch: str, scale: float = 1 / 0.07, block: int = 512) -> DataFrame:
    """(batch, loss, rows): the symmetric contrastive loss of each batch.

    rows: batch, id (unique in it), state and action (vectors), state_key, action_key, group. Of all states with all actions of a
    batch, those with an equal state key or an equal action key are positives; others of one's own group are masked. Loss is
    the mean, over states and over actions, of log-sum-exp over what is not masked less that over positives. Null keys and
    groups equal nothing but the own row, which is always a positive.

    Blocks of a batch meet block by block, as matrices; what leaves a pair of blocks is a maximum and a sum for each row and
    column, and these are merged by id, so that a batch of any size fits. Batches with more than one block cost the
    square of their rows, as the loss does.
    """
    own = rows.where("state IS NOT NULL AND action IS NOT NULL").select(F.col(batch).alias("batch"), F.col("id").cast("long").alias("id"), F.col("state").cast("array<double>").alias("state"), F.col("action").cast("array<double>").alias("action"), *(F.xxhash64(c).alias(c) for c in ("state_key", "action_key", "group")), *(F.col(c).isNotNull().alias(f"has_{c}") for c in ("state_key", "action_key", "group")))
    sizes = own.groupBy("batch").agg(F.count("*").alias("n"))
    dealt = own.join(sizes, "batch").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)))
    held = dealt.groupBy("batch", "part").agg(F.collect_list(F.struct("id", "state", "action", "state_key", "action_key", "group", "has_state_key", "has_action_key", "has_group")).alias("x"))
    pairs = held.select("batch", F.col("x").alias("rows")).join(held.select("batch", F.col("x").alias("columns")), "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, left, right in zip(*(b.column(c) for c in range(3))):
                yield _block_sums(name.as_py(), pa.Table.from_struct_array(left.values), pa.Table.from_struct_array(right.values), scale)

    kind = own.schema["batch"].dataType.simpleString()
    parts = pairs.mapInArrow(run, f"batch {kind}, side string, id long, top double, total double, top_positive double, total_positive double")
    merged = "log(aggregate(x, 0D, (s, p) -> s + p.{n} * exp(p.{m} - array_max(transform(x, q -> q.{m}))))) + array_max(transform(x, q -> q.{m}))"
    by_row = parts.groupBy("batch", "side", "id").agg(F.collect_list(F.struct("top", "total", "top_positive", "total_positive")).alias("x"))
    one = by_row.select("batch", "side", F.expr(f"({merged.format(m='top', n='total')}) - ({merged.format(m='top_positive', n='total_positive')})").alias("loss"))
    sides = one.groupBy("batch", "side").agg(F.avg("loss").alias("loss"), F.count("*").alias("rows"))
    return sides.groupBy("batch").agg(F.avg("loss").alias("loss"), F.max("rows").alias("rows"))


def _block_sums(name, left: pa.Table, right: pa.Table, scale: float) -> pa.RecordBatch:
    """Maxima and sums of exponentials by row and by column of one pair of blocks, of all that counts and of positives."""
    column = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
    matrix = lambda t, c: np.stack([np.asarray(v.values) for v in t[c].combine_chunks()])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    i, j = column(left, "id"), column(right, "id")
    logits = unit(matrix(left, "state")) @ unit(matrix(right, "action")).T * scale
    equal = lambda c: (column(left, c)[:, None] == column(right, c)[None]) & column(left, f"has_{c}")[:, None].astype(bool) & column(right, f"has_{c}")[None].astype(bool)
    positive = equal("state_key") | equal("action_key") | (i[:, None] == j[None])
    counted = positive | ~equal("group")
    out = []
    for axis, ids, side in ((1, i, "state"), (0, j, "action")):
        sums = []
        for mask in (counted, positive):
            z = np.where(mask, logits, -np.inf)
            top = z.max(axis)
            top = np.where(np.isfinite(top), top, -1e300)  # nothing in this block
            sums += [top, np.where(mask, np.exp(np.minimum(z - np.expand_dims(top, axis), 0)), 0).sum(axis)]
        out.append([np.full(len(ids), side), ids, *sums])
    side, ids, *sums = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(side.tolist(), pa.string()), pa.array(ids), *map(pa.array, sums)], ["batch", "side", "id", "top", "total", "top_positive", "total_positive"])
