"""Trajectories and conversations: resets, goals, steps with history, budgets, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def after_last(rows: DataFrame, key: str, order: list[str], mark: Column) -> DataFrame:
    """Rows after the last marked one of each sequence; sequences without a mark give no rows."""
    r = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    last = r.where(mark).groupBy(key).agg(F.max("place").alias("last"))
    return r.join(last, key).where(F.col("place") > F.col("last")).drop("last")


def goals(rows: DataFrame, key: str, order: list[str], observation: Column, action: Column, text: str) -> DataFrame:
    """(key, goal): the last observation before the first action."""
    r = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    first = r.where(action).groupBy(key).agg(F.min("place").alias("first"))
    return r.where(observation).join(first, key).where(F.col("place") < F.col("first")).groupBy(key).agg(F.max_by(text, "place").alias("goal"))


def steps(rows: DataFrame, key: str, order: list[str], emitted: Column, entry: Column, most: int = 6) -> DataFrame:
    """The emitted rows with the entries of up to `most` rows before, whether those were emitted or not."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-most, -1)
    return rows.withColumn("history", F.collect_list(entry).over(w)).where(emitted)


def packed(rows: DataFrame, key: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Newest rows of each sequence while their sum is within the budget; the newest alone may be cut to it."""
    w = W.partitionBy(key).orderBy(*order)
    r = rows.withColumn("back", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return r.where((F.col("used") <= budget) | (F.col("back") == 1)).withColumn("taken", F.least(size, F.lit(budget)))


def running_offsets(rows: DataFrame, order: str, size: Column, buckets: int = 256) -> DataFrame:
    """start: the sum of the sizes before, in order of a numeric id; in two steps, so that no task has all rows."""
    span = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if span["lo"] is None:
        return rows.withColumn("start", F.lit(None).cast("bigint"))
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // buckets))
    r = rows.withColumn("__b", F.floor((F.col(order) - span["lo"]) / width)).withColumn("__n", size)
    sums = r.groupBy("__b").agg(F.sum("__n").alias("__s"))  # at most `buckets` rows
    sums = sums.withColumn("__first", F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).drop("__s")
    within = F.sum("__n").over(W.partitionBy("__b").orderBy(order)) - F.col("__n")
    return r.join(sums, "__b").withColumn("start", F.col("__first") + within).drop("__b", "__n", "__first")


def balanced_draws(spark, rows: DataFrame, source: str, order: list[Column], counts: int, seed: str) -> DataFrame:
    """(step, source, id): draws with replacement, uniform over sources and then over a source's rows, by hash."""
    from ..functions.text import hex_int, sha

    from .ranks import placed_within

    ranked = placed_within(rows, source, *order)
    sizes = ranked.groupBy(source).agg(F.count("*").alias("size")).withColumn("at", F.row_number().over(W.orderBy(source)) - 1).withColumn("sources", F.count("*").over(W.partitionBy()))
    n = sizes.count()
    draws = spark.range(counts).select(F.col("id").alias("step"), (hex_int(sha(seed, "source", F.col("id")), 8) % n).alias("at"), hex_int(sha(seed, "row", F.col("id")), 8).alias("r"))
    return draws.join(sizes, "at").withColumn("place", F.col("r") % F.col("size")).join(ranked, [source, "place"])


def warmup_cosine(step: Column, warmup: int, steps: int) -> Column:
    done = (step - warmup) / F.lit(max(1, steps - warmup))
    return F.when(step < warmup, (step + 1) / F.lit(warmup)).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def length_batches(rows: DataFrame, size: str, id_: str, chunk: int = 256, batch: int = 16, seed: str = "epoch") -> DataFrame:
    """(chunk, batch, place): rows in hash order, sorted by length inside chunks, cut into batches."""
    from ..functions.text import sha
    from .ranks import placed

    r = placed(rows, sha(seed, F.col(id_)), id_)
    r = r.withColumn("chunk", F.floor(F.col("place") / chunk))
    inside = F.row_number().over(W.partitionBy("chunk").orderBy(size, id_)) - 1
    return r.withColumn("inside", inside).withColumn("batch", F.floor(F.col("inside") / batch))


def microbatches(rows: DataFrame, group: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Adds microbatch: rows join the current one until `most` rows or the padded size (rows x longest) passes the budget.

    A fold in order over each group's rows, whose sizes are held as one array; groups are batches of a bounded size.
    """
    packed = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("r"))
    fold = f"""aggregate(r, named_struct('out', cast(array() as array<int>), 'k', 0, 'n', 0, 'top', 0L),
        (a, x) -> CASE WHEN a.n > 0 AND (a.n >= {most} OR (a.n + 1) * greatest(a.top, cast(x.{size} as bigint)) > {budget})
          THEN named_struct('out', concat(a.out, array(a.k + 1)), 'k', a.k + 1, 'n', 1, 'top', cast(x.{size} as bigint))
          ELSE named_struct('out', concat(a.out, array(a.k)), 'k', a.k, 'n', a.n + 1, 'top', greatest(a.top, cast(x.{size} as bigint))) END,
        a -> a.out)"""
    both = packed.withColumn("m", F.expr(fold)).select(group, F.explode(F.arrays_zip("r", "m")).alias("x"))
    return both.select(group, F.col(f"x.r.{order}").alias(order), F.col(f"x.r.{size}").alias(size), F.col("x.m").alias("microbatch"))
