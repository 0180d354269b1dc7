"""Paired cluster bootstrap with draws by hash, so that reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import hex_int, sha


def cluster_sums(scores: DataFrame, cluster: str) -> DataFrame:
    """(family, cluster, place, clusters, system, credit, n): what is drawn is small, whatever the rows."""
    sums = scores.groupBy("family", cluster, "system").agg(F.sum("credit").alias("credit"), F.count("*").alias("n"))
    places = sums.select("family", cluster).distinct().withColumn("place", F.row_number().over(W.partitionBy("family").orderBy(cluster)) - 1).withColumn("clusters", F.count("*").over(W.partitionBy("family")))
    return sums.join(places, ["family", cluster])


def replicates(sums: DataFrame, n: int, seed: str) -> DataFrame:
    """(replicate, family, system, accuracy): clusters drawn with replacement, the same draws for all systems."""
    families = sums.select("family", "clusters").distinct()
    slots = families.select("family", "clusters", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("clusters") - 1)).alias("slot"))
    draws = slots.withColumn("place", hex_int(sha(seed, F.col("family"), F.col("replicate"), F.col("slot")), 8) % F.col("clusters"))
    # equal draws count once, with their number
    draws = draws.groupBy("replicate", "family", "place").agg(F.count("*").alias("times"))
    return draws.join(sums.drop("clusters"), ["family", "place"]).groupBy("replicate", "family", "system").agg((F.sum(F.col("credit") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("accuracy"))


def gain_interval(reps: DataFrame, system: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Macro gain of a system over the best other one, recomputed in each replicate: mean and interval."""
    macro = reps.groupBy("replicate", "system").agg(F.avg("accuracy").alias("accuracy"))
    gain = macro.groupBy("replicate").agg((F.max(F.when(F.col("system") == system, F.col("accuracy"))) - F.max(F.when(F.col("system") != system, F.col("accuracy")))).alias("gain"))
    return gain.agg(F.count("*").alias("replicates"), F.avg("gain").alias("mean_gain"), F.percentile("gain", F.lit(low)).alias("low"), F.percentile("gain", F.lit(high)).alias("high"))
