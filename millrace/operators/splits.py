"""Stable splits by hash, rank or attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import bucket, hex_int, sha


def by_threshold(value: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F.lit(last)
    for below, name in reversed(steps):
        out = F.when(value < below, name).otherwise(out)
    return out


def grouped(group: Column, seed: str) -> Column:
    """65/15/10/10 by the seeded hash of the group."""
    return by_threshold(bucket(sha(seed, group), 12, 100), [(65, "train"), (80, "development"), (90, "calibration")], "final")


def grouped_90(digest: Column) -> Column:
    """90/4/2/4 by the group's own digits."""
    return by_threshold(bucket(digest, 12, 100), [(90, "train"), (94, "validation"), (96, "calibration")], "test")


def grouped_80(group: Column) -> Column:
    """80/10/5/5 by the hash of the group."""
    return by_threshold(bucket(sha(group), 12, 100), [(80, "train"), (90, "validation"), (95, "calibration")], "test")


def routed(partition: Column, digest: Column) -> Column:
    """The train partition stays; others go 25/15/60 by 8 digits."""
    return F.when(partition == "train", "train").otherwise(by_threshold(bucket(digest, 8, 100), [(25, "development"), (40, "calibration")], "final"))


def by_attribute(value: Column, fixed: dict[str, str], digest: Column, n: int, hit: str, other: str) -> Column:
    """Listed values have their split; others `hit` where the hash is 0 modulo n."""
    out = F.when(bucket(digest, 8, n) == 0, hit).otherwise(other)
    for k, v in fixed.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def label_ranks(labels: DataFrame, label: str, seed: str, steps: list[tuple[int, str]], last: str) -> DataFrame:
    """(label, rank, split): distinct labels in the order of their seeded hash, split by rank."""
    ranked = labels.select(label).distinct().withColumn("rank", F.row_number().over(W.orderBy(sha(seed, F.col(label)), label)) - 1)
    return ranked.withColumn("split", by_threshold(F.col("rank"), steps, last))


def permuted(options: Column, seed: Column) -> Column:
    """Options in the order of sha(seed:place): array of (key, place, option)."""
    return F.array_sort(F.transform(options, lambda x, i: F.struct(F.sha2(F.concat_ws(":", seed, i.cast("string")), 256).alias("key"), i.alias("place"), x.alias("option"))))


def int_key(digest: Column) -> Column:
    return hex_int(digest, 15)


def conflicts(rows: DataFrame, key: str) -> DataFrame:
    """Keys that lie in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def without_conflicts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys lies in two splits: all copies of a conflict go."""
    for key in keys:
        rows = rows.join(conflicts(rows, key).select(key), key, "left_anti")
    return rows


def shared_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, left, right): pairs of splits that share a key; empty if splits are disjoint."""
    a = rows.select(key, F.col("split").alias("left")).distinct()
    return a.join(a.select(key, F.col("left").alias("right")), key).where(F.col("left") < F.col("right"))
