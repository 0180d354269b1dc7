"""Row validation, audits, gates, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def error_codes(checks: list[tuple[str, Column]]) -> Column:
    """The codes of all checks that hold, as an array."""
    return F.filter(F.array(*(F.when(bad, F.lit(code)) for code, bad in checks)), lambda x: x.isNotNull())


def code_counts(rows: DataFrame, codes: Column) -> DataFrame:
    return rows.select(F.explode(codes).alias("code")).groupBy("code").count()


def require(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows; a job over them fails at the first bad one."""
    return rows.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def capped_report(issues: DataFrame, kind: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` examples of each kind, with the count of all; ranks are limited before rows of a kind meet."""
    totals = issues.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("total"))
    first = issues.withColumn("n", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where(F.col("n") <= most)
    return first.join(totals, F.col(kind).eqNullSafe(F.col("__kind"))).drop("__kind")


def row_errors(fields: dict[str, Column], split: Column, splits: list[str], metric: Column, metrics: list[str], candidates: Column, norm, target: Column, probs: Column) -> Column:
    """All codes of a row as a sorted array. Wrong candidates end the checks: what follows would be about other candidates.

    fields: those that must not be blank. norm makes candidates comparable; target and probs are supervision, one of which a row needs.
    """
    n = F.coalesce(F.size(candidates), F.lit(0))
    blank = F.exists(candidates, lambda x: x.isNull() | (F.trim(x) == ""))
    fits = F.size(F.array_distinct(F.transform(candidates, norm)))
    general = [*((f"missing_{name}", c.isNull() | (F.trim(c) == "")) for name, c in fields.items()), ("unknown_split", ~F.coalesce(split, F.lit("")).isin(splits)), ("unknown_metric", ~F.coalesce(metric, F.lit("")).isin(metrics))]
    about = [("candidates_missing", candidates.isNull()), ("candidates_too_few", candidates.isNotNull() & (n < 2)), ("candidates_too_many", n > 64), ("candidate_blank", blank), ("candidates_repeated", ~F.coalesce(blank, F.lit(True)) & (fits < n))]
    sum_ = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    supervised = [
        ("supervision_missing", target.isNull() & probs.isNull()), ("target_out_of_range", (target < 0) | (target >= n)), ("probs_wrong_length", F.size(probs) != n),
        ("probs_not_finite", F.exists(probs, lambda x: x.isNull() | F.isnan(x))), ("probs_negative", F.exists(probs, lambda x: x < 0)), ("probs_wrong_sum", F.abs(sum_ - 1) > 1e-5),
    ]
    wrong = error_codes(about)
    return F.array_sort(F.concat(error_codes(general), F.when(F.size(wrong) > 0, wrong).otherwise(error_codes(supervised))))


def split_audit(rows: DataFrame, group: str, family: str) -> DataFrame:
    """By split: cases, distinct groups, and counts by family as a map."""
    counts = rows.groupBy("split", family).agg(F.count("*").alias("n"))
    maps = counts.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(family, "n")))).alias("families"))
    return rows.groupBy("split").agg(F.count("*").alias("cases"), F.countDistinct(group).alias("groups")).join(maps, "split")


def tree_hash(files: DataFrame, path: str, digest: str) -> DataFrame:
    """One hash of all files by path; a list of files, not of rows."""
    line = F.concat(F.col(path), F.lit("|"), F.col(digest), F.lit("\n"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("tree_hash"))


def same_population(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    return left.join(right, key, "full").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("only"))


def gates(metrics: DataFrame, accuracy: float, coverage: float) -> DataFrame:
    checked = metrics.withColumn("accuracy_ok", F.col("macro_accuracy") >= accuracy).withColumn("coverage_ok", F.col("macro_coverage") >= coverage)
    return checked.withColumn("qualified", F.col("accuracy_ok") & F.col("coverage_ok"))


def stale_runs(history: DataFrame, step: str, score: str, patience: int) -> DataFrame:
    """Adds best_so_far, stale (checks since the last gain) and stop, over a training history."""
    w = W.orderBy(step)
    before = F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    h = history.withColumn("gain", before.isNull() | (F.col(score) > before)).withColumn("run", F.sum(F.col("gain").cast("int")).over(w))
    stale = F.row_number().over(W.partitionBy("run").orderBy(step)) - 1
    return h.withColumn("stale", stale).withColumn("stop", F.col("stale") >= patience).withColumn("best_so_far", F.max(score).over(w))
