"""Rows of first generations: preference pairs, replies as steps, trajectories, typed questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

REPLY = "commands array<struct<keystrokes:string>>, task_complete boolean"


def preference_reason(chosen: Column, rejected: Column, gap: Column, least: float = 1.0) -> Column:
    """Why a pair of message lists (array<struct<role, content>>) is no preference; null if it is one.

    Checked in this order: the score gap, the messages before the last, the role of the last.
    """
    history = lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))
    last = lambda m: F.element_at(m, -1)["role"]
    none = F.coalesce(F.size(chosen), F.lit(0)).isin(0, -1) | F.coalesce(F.size(rejected), F.lit(0)).isin(0, -1)
    return (
        F.when(F.coalesce(gap, F.lit(0.0)) < least, "score_gap")
        .when(none, "history_mismatch")
        .when(F.to_json(history(chosen)) != F.to_json(history(rejected)), "history_mismatch")
        .when((last(chosen) != "assistant") | (last(rejected) != "assistant"), "not_assistant")
    )


def reply_action(reply: Column) -> Column:
    """The keystrokes of a reply in JSON, one a line; a marker for an empty one that says it is complete; null if there is none."""
    r = F.from_json(reply, REPLY)
    keys = F.trim(F.array_join(F.transform(r["commands"], lambda c: F.coalesce(c["keystrokes"], F.lit(""))), "\n"))
    return F.when(r["commands"].isNotNull() & (keys != ""), keys).when(r["task_complete"], F.lit("Finish: the task is complete."))


def completed(reply: Column) -> Column:
    return F.coalesce(F.from_json(reply, REPLY)["task_complete"], F.lit(False))


def conversation_steps(rows: DataFrame, key: str, order: str, reply: Column, text: str, most: int = 6) -> DataFrame:
    """The replies with an action, and the `most` entries before them; replies without one are no entries.

    Only conversations in which some reply says that the task is complete. reply: whether a row is one. Adds action, history.
    """
    done = rows.where(reply).groupBy(key).agg(F.bool_or(completed(F.col(text))).alias("done")).where("done").select(key)
    r = rows.join(done, key, "left_semi").withColumn("reply", reply).withColumn("action", F.when(F.col("reply"), reply_action(F.col(text))))
    r = r.where(~F.col("reply") | F.col("action").isNotNull())
    entry = F.when(F.col("reply"), F.concat(F.lit("Action: "), "action")).otherwise(F.concat(F.lit("Observation: "), text))
    return r.withColumn("history", F.collect_list(entry).over(W.partitionBy(key).orderBy(order).rowsBetween(-most, -1))).where("reply").drop("reply")


def trajectory_steps(rows: DataFrame, key: str, order: str, observation: Column, action: Column, text: Column, most: int = 6) -> DataFrame:
    """The actions with their context: the first two observations of all, and the last `most` entries before.

    Rows that are neither are no entries. Adds context.
    """
    r = rows.withColumn("observed", observation).withColumn("acted", action).withColumn("entry_text", text).where("observed OR acted")
    so_far, whole = (W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, W.unboundedFollowing))
    r = r.withColumn("nth", F.sum(F.col("observed").cast("int")).over(so_far))
    r = r.withColumn("initial", F.array_join(F.collect_list(F.when(F.col("observed") & (F.col("nth") <= 2), F.col("entry_text"))).over(whole), "\n"))
    entry = F.concat(F.when(F.col("acted"), F.lit("Action: ")).otherwise(F.lit("Observation: ")), "entry_text")
    history = F.array_join(F.collect_list(entry).over(W.partitionBy(key).orderBy(order).rowsBetween(-most, -1)), "\n")
    return r.withColumn("context", F.concat("initial", F.lit("\n\nRecent history:\n"), history)).where("acted").drop("observed", "acted", "entry_text", "nth", "initial")


def pair_issue(positive: Column, negative: Column, norm) -> Column:
    """Why a pair of texts is set aside: a blank positive, or both alike when normalised; null if it is valid."""
    return F.when(positive.isNull() | (F.trim(positive) == ""), "blank").when(norm(positive) == norm(F.coalesce(negative, F.lit(""))), "same")


def fits(state: Column, candidates: Column, tokens, separator: str, chars: tuple[int, int], most: tuple[int, int, int]) -> Column:
    """Whether a state, each candidate, and each joint text are within their bounds. chars: below, for state and candidates; most:
    tokens at most, for state, candidates and joint texts. A state that is null, or without candidates, does not fit."""
    each = F.forall(candidates, lambda c: (F.length(c) < chars[1]) & (tokens(c) <= most[1]) & (tokens(F.concat(state, F.lit(separator), c)) <= most[2]))
    return F.coalesce((F.length(state) < chars[0]) & (tokens(state) <= most[0]) & (F.size(candidates) > 0) & each, F.lit(False))


def built(rows: DataFrame, keep: list[str], defaults: dict[str, object], given: dict[str, Column]) -> DataFrame:
    """Rows with every field of `defaults`: what `given` has, where it is not null, else the default."""
    return rows.select(*keep, *(F.coalesce(given[k], F.lit(v)).alias(k) if k in given else F.lit(v).alias(k) for k, v in defaults.items()))


def boolean_alias(true: Column, false: Column, yes: Column, no: Column) -> Column:
    """struct<true, false, error>: yes and no stand for true and false; both names of one side are an error."""
    both = (true.isNotNull() & yes.isNotNull()) | (false.isNotNull() & no.isNotNull())
    return F.struct(F.when(~both, F.coalesce(true, yes)).alias("true"), F.when(~both, F.coalesce(false, no)).alias("false"), F.when(both, "repeated").alias("error"))


def cluster_key(synthetic: Column, workflow: Column, group: Column) -> Column:
    """Generated rows are drawn together by their workflow, others by their prompt."""
    return F.when(synthetic, workflow).otherwise(group)
