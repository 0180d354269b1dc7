"""Places and running sums over a whole table, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .near import materialised

#: monotonically_increasing_id has the partition above these bits, and the row's place in its partition below.
_BITS = 33


def placed(rows: DataFrame, *order: Column | str, size: Column | None = None) -> DataFrame:
    """Adds place, from 0, in this order, and with a size also start, the sum of the sizes before.

    Rows are dealt into ranges of the order and sorted there, once; each range's count and sum come to the driver (one
    row a partition), and what lies before a range is added inside it. The last key must be unique for the
    places to be the same in every run. Null sizes count as 0.
    """
    keys = [f"__o{k}" for k in range(len(order))]
    keyed = rows.select("*", *(F.expr(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in zip(keys, order)), *([F.coalesce(size, F.lit(0)).cast("bigint").alias("__n")] if size is not None else []))
    dealt = materialised(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _BITS)
    sums = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum("__n" if size is not None else F.lit(0)).alias("total")).collect()
    before, place, start = [], 0, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before.append((r["part"], place, start))
        place, start = place + r["rows"], start + r["total"]
    ranges = rows.sparkSession.createDataFrame(before, T.StructType([T.StructField(c, T.LongType()) for c in ("__part", "__rows", "__sum")]))
    out = dealt.withColumn("__part", part).join(F.broadcast(ranges), "__part").withColumn("place", F.col("__rows") + F.col("__at").bitwiseAND((1 << _BITS) - 1))
    if size is not None:
        out = out.withColumn("start", F.col("__sum") + F.sum("__n").over(W.partitionBy("__part").orderBy("__at")) - F.col("__n"))
    return out.drop("__at", "__part", "__rows", "__sum", "__n")


def placed_within(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """Adds place, from 0, in each group: one order over all, less the group's first place, so that a large group is spread too.

    Groups are compared with one row each; null is a group.
    """
    whole = materialised(placed(rows, F.col(group), *order))
    first = whole.groupBy(F.col(group).alias("__g")).agg(F.min("place").alias("__first"))
    return whole.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn("place", F.col("place") - F.col("__first")).drop("__g", "__first")


def percentiles(rows: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """(group, n, one column a point): exact percentiles with linear interpolation, null values left out.

    By places in one order over all groups, so that no task holds a group's values; two rows a group and point are picked.
    """
    own = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("__v"))
    ranked = placed_within(own, group, "__v")
    sizes = ranked.groupBy(F.col(group).alias("__of")).agg(F.count("*").alias("n"))
    r = ranked.join(sizes, F.col(group).eqNullSafe(F.col("__of"))).drop("__of")
    out = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("n") - 1)
        low = F.max(F.when(F.col("place") == F.floor(at), F.col("__v")))
        high = F.max(F.when(F.col("place") == F.ceil(at), F.col("__v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    edge = F.lit(False)
    for p in points.values():
        edge = edge | (F.abs(F.col("place") - F.lit(p) * (F.col("n") - 1)) < 1)
    return r.where(edge).groupBy(group).agg(F.max("n").alias("n"), *out)
