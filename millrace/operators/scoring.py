"""Scores of ranked candidates: one pass over arrays of logits, no shuffle until groups are averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(logits, lambda z: (z - F.array_max(logits)) / t)
    # the sum is bound once, as the only element of an array, and not computed again for each logit
    once = F.transform(F.array(scaled), lambda x: F.struct(x.alias("z"), F.log(total(F.transform(x, F.exp))).alias("lse")))
    return F.get(F.transform(once, lambda s: F.transform(s["z"], lambda z: z - s["lse"])), F.lit(0))


def one_hot(target: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == target).cast("double"))


def target_distribution(target_probs: Column, target: Column, n: Column) -> Column:
    return F.coalesce(target_probs, one_hot(target, n))


def target_error(target_probs: Column, n: Column, tolerance: float = 1e-5) -> Column:
    """What is wrong with a row's soft target; null if nothing is, or it has none."""
    wrong = F.exists(target_probs, lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")))
    return F.when(F.size(target_probs) != n, "length").when(wrong, "not finite").when(F.exists(target_probs, lambda p: p < 0), "negative").when(F.abs(total(target_probs) - 1) > tolerance, "sum")


def credit(logits: Column, target: Column, tolerance: float = 0.0) -> Column:
    """The mean target mass over the logits that tie with the best (exactly, or within a tolerance)."""
    top = F.array_max(logits)
    ties = F.filter(F.zip_with(logits, target, lambda z, t: F.when(top - z <= tolerance, t)), lambda x: x.isNotNull())
    return total(ties) / F.size(ties)


def nll(logp: Column, target: Column) -> Column:
    return -total(F.zip_with(logp, target, lambda lp, t: F.when(t > 0, t * lp).otherwise(0.0)))


def brier(logp: Column, target: Column) -> Column:
    return total(F.zip_with(logp, target, lambda lp, t: (F.exp(lp) - t) * (F.exp(lp) - t)))


def expected(probs: Column, values: Column) -> Column:
    return total(F.zip_with(probs, values, lambda p, v: p * v))


def confidence(probs: Column) -> Column:
    """The best probability less the mean of the others, within 0 and 1; 1 for fewer than two options."""
    top = F.array_max(probs)
    return F.when(F.size(probs) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), top - (total(probs) - top) / (F.size(probs) - 1))))


def first_best(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def scored(rows: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """Adds credit, nll, brier; missing logits give credit 0, and null for the others."""
    lp = F.col("logp")
    r = rows.withColumn("t", target_distribution(F.col("target_probs"), F.col("target"), F.col("n"))).withColumn("logp", log_softmax(F.col("logits"), temperature))
    return r.select("*", F.coalesce(credit(F.col("logits"), F.col("t")), F.lit(0.0)).alias("credit"), nll(lp, F.col("t")).alias("nll"), brier(lp, F.col("t")).alias("brier")).drop("t", "logp")


def family_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all planned rows, coverage, and means over the covered ones."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("cases"), F.avg("credit").alias("accuracy"), F.avg(F.col("nll").isNotNull().cast("double")).alias("coverage"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier")
    )


def macro(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of family means, all families alike."""
    return metrics.groupBy(*by).agg(F.count("*").alias("families"), F.avg("accuracy").alias("macro_accuracy"), F.avg("coverage").alias("macro_coverage"), F.avg("nll").alias("macro_nll"))


def temperature_grid(spark, n: int = 121, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """(step, t): n values from low to high, evenly in the logarithm."""
    return spark.range(n).select(F.col("id").alias("step"), F.pow(F.lit(10.0), F.log10(F.lit(low)) + F.col("id") * (F.log10(F.lit(high)) - F.log10(F.lit(low))) / (n - 1)).alias("t"))


def fit_temperature(rows: DataFrame, n: int = 121) -> DataFrame:
    """(system, step, t, loss): the temperature of least mean family loss, the first of equals.

    One pass: a row has its n losses in one array, and only those are taken apart, not copies of its logits.
    """
    grid = [r["t"] for r in temperature_grid(rows.sparkSession, n).orderBy("step").collect()]  # n values
    every = F.array(*map(F.lit, grid))
    top = F.array_max("logits")
    r = spread(rows).select("system", "family", F.transform("logits", lambda z: z - top).alias("z"), (F.get(F.col("logits"), F.col("target")) - top).alias("hit"))
    losses = F.transform(every, lambda t: F.log(F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z / t))) - F.col("hit") / t)
    by_family = r.select("system", "family", F.posexplode(losses).alias("step", "nll")).groupBy("system", "family", "step").agg(F.avg("nll").alias("nll"))
    loss = by_family.groupBy("system", "step").agg(F.round(F.avg("nll"), 9).alias("loss"))
    best = loss.groupBy("system").agg(F.min(F.struct("loss", "step")).alias("b"))
    return best.select("system", F.col("b.step").cast("bigint").alias("step"), F.get(every, F.col("b.step")).alias("t"), "b.loss")
