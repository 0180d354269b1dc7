"""Repair of a partition: training groups near held-out rows go, then those that show what only removed groups own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digests import table_digest
from .near import materialised


def owned(metric: Column, source: Column, target: Column, candidates: Column, preferences: list[str]) -> Column:
    """The candidates that are a row's own data: all of a preference row, none of an ordinal one (its legend is shared), else
    the one at `target` (from 0); what else it shows was drawn from other groups."""
    return (
        F.when(metric == "ordinal", F.slice(candidates, 1, 0))
        .when(source.isin(preferences), candidates)
        .when(target.isNotNull(), F.slice(candidates, F.least(target + 1, F.size(candidates) + 1), F.lit(1)))
        .otherwise(F.slice(candidates, 1, 0))
    )


@dataclass(frozen=True)
class Repair:
    """train: all training rows with reason (near, candidate, null: kept), pass and new_id (null: removed); digests: (part,
    rows, digest) of the held-out rows before and after, and of the rows kept."""

    train: DataFrame
    digests: DataFrame


def contaminated_groups(owners: DataFrame, shown: DataFrame, direct: DataFrame) -> DataFrame:
    """(group, pass) of groups to remove; pass 0 are those in `direct`.

    owners, shown: (group, text). In each pass a text all of whose owners are removed is forbidden, and groups that
    show it go, until a pass finds none. A text that a kept group owns as well stays allowed. All by joins on texts and
    groups; a text shown by many groups costs a row each.
    """
    owners, shown = materialised(owners.distinct()), materialised(shown.distinct())
    gone = materialised(direct.select("group").distinct().withColumn("pass", F.lit(0)))
    turn = 0
    while True:
        turn += 1
        state = owners.join(gone, "group", "left").groupBy("text").agg(F.count("*").alias("owners"), F.count("pass").alias("gone"))
        forbidden = state.where("owners = gone").select("text")
        more = shown.join(forbidden, "text", "left_semi").select("group").distinct().join(gone, "group", "left_anti")
        more = materialised(more.withColumn("pass", F.lit(turn)))
        if not more.limit(1).count():
            return gone
        gone = materialised(gone.union(more))


def repair(rows: DataFrame, direct: DataFrame, most: int, content: list[str], preferences: list[str]) -> Repair:
    """rows: id, group, train (whether it may be removed), metric, source, target, candidates (normalised), and `content`.

    direct: (group) that are near a held-out row. ValueError if more than `most` training rows would go, or if ids are
    still repeated when those of kept rows that occur anywhere else are followed by a hash of their content. Held-out
    rows are not touched: the digests prove it. Null groups are kept, candidates that are null are not compared.
    """
    rows = materialised(rows)
    train = rows.where("train")
    own = owned(F.col("metric"), F.col("source"), F.col("target"), F.col("candidates"), preferences)
    texts = lambda c: train.where("group IS NOT NULL").select("group", F.explode(F.array_compact(c)).alias("text"))
    gone = contaminated_groups(texts(own), texts(F.col("candidates")), direct.join(train.select("group"), "group", "left_semi"))
    marked = materialised(train.join(gone, "group", "left"))
    lost = marked.where("pass IS NOT NULL").limit(most + 1).count()
    if lost > most:
        raise ValueError(f"more than {most} training rows would be removed")
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("__id"))
    mark = F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256), 1, 16)
    named = marked.join(repeated, F.col("id").eqNullSafe(F.col("__id")), "left")
    new = F.when(F.col("pass").isNotNull(), None).when(F.col("__id").isNotNull(), F.concat("id", F.lit(":input-"), mark)).otherwise(F.col("id"))
    reason = F.when(F.col("pass") == 0, "near").when(F.col("pass") > 0, "candidate")
    out = materialised(named.withColumn("new_id", new).withColumn("reason", reason).drop("__id"))
    held = rows.where("NOT train")
    ids = held.select("id").union(out.where("reason IS NULL").select("new_id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").join(out.where("reason IS NULL").select(F.col("new_id").alias("id")), "id", "left_semi").limit(1).count():
        raise ValueError("ids are still repeated after they were qualified by content")
    columns = ["id", "group", *content]
    after = held.unionByName(out.where("reason IS NULL").drop("id").withColumnRenamed("new_id", "id").select(*held.columns))
    parts = [(rows, "NOT train", "held_out_before"), (after, "NOT train", "held_out_after"), (after, "train", "train_after")]
    digests = None
    for frame, which, part in parts:
        one = table_digest(frame.where(which), None, columns).withColumn("part", F.lit(part))
        digests = one if digests is None else digests.union(one)
    return Repair(out, digests.select("part", "rows", "digest"))
