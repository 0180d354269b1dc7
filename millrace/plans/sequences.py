"""Queries over conversations and events: steps with history, resets, goals, budgets, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import ranks as R
from ..operators import sequences as Sq
from ..operators import validation as V
from ..registry import Tables, query
from .sql import h

_ENTRY = "role||':'||text"


@query(f"""WITH x AS (SELECT conv_id, turn, role, list({_ENTRY}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS hist FROM conversations)
SELECT conv_id, turn, len(coalesce(hist, []))::int AS history_size, sha256(array_to_string(coalesce(hist, []), '|')) AS history_hash FROM x WHERE role = 'assistant'""")
def history_steps(t: Tables) -> DataFrame:
    s = Sq.steps(t.conversations, "conv_id", ["turn"], F.col("role") == "assistant", F.expr(_ENTRY))
    return s.select("conv_id", "turn", F.size("history").alias("history_size"), F.sha2(F.array_join("history", "|"), 256).alias("history_hash"))


@query("""WITH f AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, sha256(arg_max(text, turn)) AS goal_hash FROM conversations JOIN f USING (conv_id) WHERE role = 'user' AND turn < f GROUP BY conv_id""")
def goal_extraction(t: Tables) -> DataFrame:
    g = Sq.goals(t.conversations, "conv_id", ["turn"], F.col("role") == "user", F.col("role") == "assistant", "text")
    return g.select("conv_id", F.sha2("goal", 256).alias("goal_hash"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), l AS (SELECT user_id, max(place) AS last FROM r WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, event_id, place::int AS place FROM r JOIN l USING (user_id) WHERE place > last""")
def trajectory_reset(t: Tables) -> DataFrame:
    return Sq.after_last(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "place")


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER w AS back, sum(length(text)) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, least(n, 600)::bigint AS taken FROM r WHERE used <= 600 OR back = 1""")
def history_budget(t: Tables) -> DataFrame:
    p = Sq.packed(t.conversations, "conv_id", [F.desc("turn")], F.length("text"), 600)
    return p.select("conv_id", "turn", F.col("taken").cast("bigint").alias("taken"))


@query("""SELECT user_id, count(*) AS events, bool_or(event_type = 'purchase') AS bought, min(event_id) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id""")
def trajectory_markers(t: Tables) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(F.count("*").alias("events"), F.bool_or(bought).alias("bought"), F.min(F.when(bought, F.col("event_id"))).alias("first_purchase"))


@query(f"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT k.k AS step, {h("'draw:source:'||k.k", 8)} AS a, {h("'draw:row:'||k.k", 8)} AS b FROM range(400) k(k))
SELECT step, r.source, r.doc_id FROM d JOIN s ON s.at = d.a % s.n JOIN r ON r.source = s.source AND r.place = d.b % r.size""")
def balanced_sampler(t: Tables) -> DataFrame:
    return Sq.balanced_draws(t.spark, t.documents.select("source", "doc_id"), "source", [F.col("doc_id")], 400, "draw").select("step", "source", "doc_id")


@query("""WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY sha256('epoch:'||doc_id), doc_id) - 1) // 16 AS step, (SELECT (count(*) + 15) // 16 FROM documents) AS steps FROM documents)
SELECT doc_id, step, round(CASE WHEN step < greatest(1, steps // 20) THEN (step + 1) / greatest(1, steps // 20)::double ELSE 0.5 * (1 + cos(pi() * (step - greatest(1, steps // 20)) / greatest(1, steps - greatest(1, steps // 20))::double)) END, 6) AS factor FROM p""")
def warmup_cosine(t: Tables) -> DataFrame:
    """The learning rate's factor at the update that sees each document: 16 a step in hash order, a twentieth of all steps to warm up."""
    steps = -(-t.documents.count() // 16)
    p = R.placed(t.documents.select("doc_id"), X.sha("epoch", F.col("doc_id")), "doc_id").withColumn("step", F.expr("place div 16"))
    return p.select("doc_id", "step", F.round(Sq.warmup_cosine(F.col("step"), max(1, steps // 20), steps), 6).alias("factor"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text)::bigint AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
f AS (SELECT conv_id, turn, p, 0 AS k, 1 AS c, n AS top FROM r WHERE p = 1 UNION ALL
SELECT r.conv_id, r.turn, r.p, CASE WHEN f.c >= 4 OR (f.c + 1) * greatest(f.top, r.n) > 1200 THEN f.k + 1 ELSE f.k END, CASE WHEN f.c >= 4 OR (f.c + 1) * greatest(f.top, r.n) > 1200 THEN 1 ELSE f.c + 1 END, CASE WHEN f.c >= 4 OR (f.c + 1) * greatest(f.top, r.n) > 1200 THEN r.n ELSE greatest(f.top, r.n) END
FROM f JOIN r ON r.conv_id = f.conv_id AND r.p = f.p + 1)
SELECT conv_id, turn, k::int AS microbatch FROM f""")
def microbatches(t: Tables) -> DataFrame:
    r = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return Sq.microbatches(r, "conv_id", "turn", "n", 1200, 4).select("conv_id", "turn", "microbatch")


@query("""WITH d AS (SELECT (epoch_ms(ts) // 86400000)::bigint AS step, round(avg(value), 6) AS score FROM events GROUP BY 1),
g AS (SELECT *, max(score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d), r AS (SELECT *, sum((before IS NULL OR score > before)::int) OVER (ORDER BY step) AS run FROM g)
SELECT step, score, (row_number() OVER (PARTITION BY run ORDER BY step) - 1)::int AS stale, row_number() OVER (PARTITION BY run ORDER BY step) - 1 >= 4 AS stop, max(score) OVER (ORDER BY step) AS best_so_far FROM r""")
def early_stop(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.expr("unix_seconds(cast(ts as timestamp)) div 86400").alias("step")).agg(F.round(F.avg("value"), 6).alias("score"))
    return V.stale_runs(days, "step", "score", 4).select("step", "score", "stale", "stop", "best_so_far")


@query("""WITH d AS (SELECT (epoch_ms(ts) // 86400000)::bigint AS step, round(avg(value), 6) AS macro, round(stddev_pop(value), 6) AS nll FROM events GROUP BY 1)
SELECT step AS best_step, macro, nll FROM d ORDER BY macro DESC, nll, step LIMIT 1""")
def best_checkpoint(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.expr("unix_seconds(cast(ts as timestamp)) div 86400").alias("step")).agg(F.round(F.avg("value"), 6).alias("macro"), F.round(F.stddev_pop("value"), 6).alias("nll"))
    return days.agg(F.max_by(F.struct("step", "macro", "nll"), F.struct("macro", -F.col("nll"), -F.col("step"))).alias("b")).select(F.col("b.step").alias("best_step"), "b.macro", "b.nll")


@query("SELECT vec_id, len(embedding)::int AS width, (len(embedding) - 1)::int AS last_index, round(embedding[len(embedding)]::double, 5) AS last_value FROM embeddings")
def last_token(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.size("embedding").alias("width"), (F.size("embedding") - 1).alias("last_index"), F.round(F.element_at("embedding", -1).cast("double"), 5).alias("last_value"))


@query("SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role)::int AS place FROM (SELECT conv_id, role, count(*) AS turns, min(turn) AS first_turn FROM conversations GROUP BY ALL)")
def distinct_first_seen(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("first_turn", "role")))
