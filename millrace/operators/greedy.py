"""Selections in which each decision depends on those before, made in rounds over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .near import materialised


def greedy(rows: DataFrame, links: DataFrame, quota: int, label_cap: int, ahead: int = 4) -> DataFrame:
    """The rows that one ordered pass would accept, as (place, cell), found in rounds.

    rows: place (unique; the order of the pass), cell, label, keys (an array: no two accepted rows share one), class (of near
    copies; null: none), blocks (whether an accepted row bars later near ones). links: (a, b) of classes that are near.
    The pass accepts a row unless a key is taken, an accepted blocking row is of its class or of one linked with it, its cell
    has `quota` rows, or its label has `label_cap` rows in its cell. A row that is left out takes nothing.

    In each round a row waits while an undecided earlier row may still bar it: one that has the least place of its keys and
    of the classes near it waits for nobody. Of each cell the first ahead * quota undecided rows are looked at. Up to the first
    of them that waits, labels and quota follow by ranks; behind it a row is accepted only where they cannot run out.
    The first undecided row of all waits for nobody, so that every round decides some; all joins are by key, class or cell,
    and groups of any size cost one row a member and round. What is accepted is a checkpoint each round.
    """
    near = materialised(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    left = materialised(rows.select("place", "cell", "label", F.array_distinct(F.array_compact("keys")).alias("keys"), "class", "blocks"))
    taken = None
    while left.limit(1).count():
        won, lost = _round(left, near, taken, quota, label_cap, ahead * quota)
        new = materialised(won)
        taken = new if taken is None else taken.union(new)
        left = left.join(new.select("place"), "place", "left_anti").join(lost, "place", "left_anti")
        left = materialised(_unbarred(left, near, new, taken, quota, label_cap))
    empty = rows.select("place", "cell").where("false")
    return taken.select("place", "cell") if taken is not None else empty


def _unbarred(left: DataFrame, near: DataFrame, new: DataFrame, taken: DataFrame, quota: int, label_cap: int) -> DataFrame:
    """What none of the rows accepted so far bars."""
    used = new.select(F.explode("keys").alias("key")).distinct()
    barred = left.select("place", F.explode("keys").alias("key")).join(used, "key", "left_semi").select("place").distinct()
    # an earlier row that bars nothing may still be undecided: only later rows are barred by a class
    own = new.where("blocks AND class IS NOT NULL").groupBy("class").agg(F.min("place").alias("m"))
    classes = own.union(near.join(own.withColumnRenamed("class", "a"), "a").select(F.col("b").alias("class"), "m")).groupBy("class").agg(F.min("m").alias("m"))
    close = left.join(classes, "class").where("place > m").select("place")
    full = taken.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= quota).select("cell")
    capped = taken.groupBy("cell", "label").agg(F.count("*").alias("n")).where(F.col("n") >= label_cap).select(F.col("cell").alias("__c"), F.col("label").alias("__l"))
    out = left.join(barred, "place", "left_anti").join(close, "place", "left_anti").join(full, "cell", "left_anti")
    return out.join(capped, (F.col("cell") == F.col("__c")) & F.col("label").eqNullSafe(F.col("__l")), "left_anti").select(*left.columns)


def _round(left: DataFrame, near: DataFrame, taken: DataFrame | None, quota: int, label_cap: int, ahead: int) -> tuple[DataFrame, DataFrame]:
    """(rows accepted, places left out) of what is sure now."""
    first = left.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("place"))).where(F.col("r") <= ahead)
    keyed = left.select("place", F.explode("keys").alias("key"))
    waits = keyed.join(keyed.groupBy("key").agg(F.min("place").alias("least")), "key").where("place > least").select("place")
    least = materialised(left.where("blocks AND class IS NOT NULL").groupBy("class").agg(F.min("place").alias("m")))
    around = least.union(near.join(least.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), "m")).groupBy("class").agg(F.min("m").alias("m"))
    waits = waits.union(left.join(around, "class").where("place > m").select("place")).distinct().withColumn("waits", F.lit(True))
    seen = materialised(first.join(waits, "place", "left").withColumn("waits", F.coalesce("waits", F.lit(False))))
    counted = seen
    for by, name in ((["cell"], "in_cell"), (["cell", "label"], "in_label")):
        have = taken.groupBy(*by).agg(F.count("*").alias(name)) if taken is not None else None
        counted = counted.withColumn(name, F.lit(0)) if have is None else _counted(counted, have, by, name)
    cell, label = W.partitionBy("cell").orderBy("place"), W.partitionBy("cell", "label").orderBy("place")
    c = counted.withColumn("wait_at", F.min(F.when(F.col("waits"), F.col("place"))).over(W.partitionBy("cell")))
    c = c.withColumn("sure", F.col("wait_at").isNull() | (F.col("place") < F.col("wait_at")))
    # behind a row that waits: all undecided rows before count as if accepted
    c = c.withColumn("before_cell", F.row_number().over(cell) - 1).withColumn("before_label", F.row_number().over(label) - 1)
    safe = ~F.col("sure") & ~F.col("waits") & (F.col("in_cell") + F.col("before_cell") < quota) & (F.col("in_label") + F.col("before_label") < label_cap)
    # up to it: of the rows of a label the first ones, and of those the first of the cell; before_label is exact there
    fits = F.col("sure") & (F.col("in_label") + F.col("before_label") < label_cap)
    c = c.withColumn("rank", F.sum(fits.cast("int")).over(cell))
    c = materialised(c.withColumn("won", (fits & (F.col("in_cell") + F.col("rank") <= quota)) | safe))
    return c.where("won").select(*left.columns), c.where("sure AND NOT won").select("place")


def _counted(rows: DataFrame, have: DataFrame, by: list[str], name: str) -> DataFrame:
    renamed = have.select(*(F.col(c).alias(f"__{c}") for c in by), name)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    both = rows.join(renamed, on[0] if len(on) == 1 else on[0] & on[1], "left").drop(*(f"__{c}" for c in by))
    return both.withColumn(name, F.coalesce(name, F.lit(0)))


def keys(**named: Column) -> Column:
    """The keys of a row: a value of another name is another key."""
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in named.items())))


def distinct_group_batches(rows: DataFrame, chunk: str, order: str, group: str, batch: int) -> DataFrame:
    """Adds batch: in each chunk, rows in order fill batches without two of one group; deferred rows come first in the next."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out, k = pdf.sort_values(order).to_dict("records"), [], 0
        while left:
            taken, later, seen = [], [], set()
            for r in left:
                if len(taken) < batch and r[group] not in seen:
                    taken.append(r | {"batch": k})
                    seen.add(r[group])
                else:
                    later.append(r)
            out, left, k = out + taken, later, k + 1
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy(chunk).applyInPandas(fold, schema)
