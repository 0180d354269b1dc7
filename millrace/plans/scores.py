"""Queries that score ranked candidates. Logits are made from hashes of documents, so that no model is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bootstrap as B
from ..operators import ranking as R
from ..operators import scoring as C
from ..operators import validation as V
from ..operators import vectors as Vec
from ..registry import Tables, query
from .sql import LOGITS, MACRO, METRICS, NORM, h

def D():
    return F.col("doc_id")


def logits(t: Tables) -> DataFrame:
    """doc_id, family, source, system, target, n, logits (null where the system has none), target_probs."""
    base = t.documents.select("doc_id", F.col("lang").alias("family"), "source", X.bucket(X.sha(D(), "target"), 8, 4).cast("int").alias("target"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system"))

    def one(i: int):
        z = X.bucket(X.sha(D(), F.lit(i), F.col("system")), 8, 40).cast("double") / 10
        return z + F.when((F.col("system") == "b") & (F.col("target") == i), 1.5).otherwise(0.0)

    there = X.bucket(X.sha(D(), "miss", F.col("system")), 8, 50) != 0
    return base.withColumn("logits", F.when(there, F.array(*map(one, range(4))))).withColumn("n", F.lit(4)).withColumn("target_probs", F.lit(None).cast("array<double>"))


def scored(t: Tables) -> DataFrame:
    return C.scored(logits(t))


@query(f"WITH {LOGITS} SELECT doc_id, system, round(credit, 6) AS credit, round(nll, 6) AS nll, round(brier, 6) AS brier FROM scored")
def credit_nll_brier(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", "system", *(F.round(c, 6).alias(c) for c in ("credit", "nll", "brier")))


@query(f"WITH {LOGITS} SELECT doc_id, system, best, round(expected, 6) AS expected, round(greatest(0, least(1, confidence)), 6) AS confidence, round(abs(expected - target), 6) AS mae FROM scored WHERE best IS NOT NULL")
def ordinal_mae(t: Tables) -> DataFrame:
    r = logits(t).where("logits IS NOT NULL").withColumn("p", F.transform(C.log_softmax(F.col("logits")), F.exp))
    e = C.expected(F.col("p"), F.transform("p", lambda p, i: i.cast("double")))
    return r.select("doc_id", "system", C.first_best(F.col("logits")).alias("best"), F.round(e, 6).alias("expected"), F.round(C.confidence(F.col("p")), 6).alias("confidence"), F.round(F.abs(e - F.col("target")), 6).alias("mae"))


@query(f"WITH {LOGITS}, t AS (SELECT doc_id, system, avg(CASE WHEN mz - z <= 0.15 THEN (i = target)::int::double END) AS c FROM z JOIN (SELECT doc_id, system, max(z) AS mz FROM z GROUP BY ALL) m USING (doc_id, system) GROUP BY ALL) SELECT system, count(*) AS rows, round(avg(c), 6) AS credit FROM t GROUP BY system")
def tie_credit(t: Tables) -> DataFrame:
    """Credit with a tolerance for ties."""
    r = logits(t).where("logits IS NOT NULL").withColumn("t", C.one_hot(F.col("target"), F.col("n")))
    return r.groupBy("system").agg(F.count("*").alias("rows"), F.round(F.avg(C.credit(F.col("logits"), F.col("t"), 0.15)), 6).alias("credit"))


@query(f"WITH {LOGITS}, {METRICS} SELECT system, family, cases, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage, round(nll, 6) AS nll, round(brier, 6) AS brier FROM metrics")
def family_metrics(t: Tables) -> DataFrame:
    return C.family_metrics(scored(t), ["system", "family"]).select("system", "family", "cases", *(F.round(c, 6).alias(c) for c in ("accuracy", "coverage", "nll", "brier")))


@query(f"WITH {LOGITS}, {METRICS}, {MACRO} SELECT system, families, round(macro_accuracy, 6) AS macro_accuracy, round(macro_coverage, 6) AS macro_coverage, round(macro_nll, 6) AS macro_nll FROM macro")
def macro_accuracy(t: Tables) -> DataFrame:
    return C.macro(C.family_metrics(scored(t), ["system", "family"]), ["system"]).select("system", "families", *(F.round(c, 6).alias(c) for c in ("macro_accuracy", "macro_coverage", "macro_nll")))


_SCOPE = "CASE WHEN doc_id % 3 = 0 THEN 'retained' ELSE 'fresh' END"


@query(f"WITH {LOGITS}, m AS (SELECT system, {_SCOPE} AS scope, family, avg(credit) AS a, avg((nll IS NOT NULL)::int::double) AS c FROM scored GROUP BY ALL) SELECT system, scope, round(avg(a), 6) AS macro_accuracy, round(avg(c), 6) AS macro_coverage FROM m GROUP BY ALL")
def scope_macro(t: Tables) -> DataFrame:
    s = scored(t).withColumn("scope", F.expr(_SCOPE))
    return C.macro(C.family_metrics(s, ["system", "scope", "family"]), ["system", "scope"]).select("system", "scope", F.round("macro_accuracy", 6).alias("macro_accuracy"), F.round("macro_coverage", 6).alias("macro_coverage"))


@query(f"WITH {LOGITS}, m AS (SELECT system, family, avg(credit) AS a FROM scored WHERE doc_id % 3 <> 0 AND source <> 'src0' GROUP BY ALL) SELECT system, round(avg(a), 6) AS fresh_macro FROM m GROUP BY system")
def fresh_macro(t: Tables) -> DataFrame:
    fresh = scored(t).where("doc_id % 3 <> 0 AND source <> 'src0'")
    return C.macro(C.family_metrics(fresh, ["system", "family"]), ["system"]).select("system", F.round("macro_accuracy", 6).alias("fresh_macro"))


@query(f"WITH {LOGITS} SELECT system, count(*) AS planned, count(nll) AS covered, round(avg(nll), 6) AS nll_covered, round(avg(nll) FILTER (family <> 'en'), 6) AS nll_other, round(sum(credit) / count(*), 6) AS accuracy_planned, round(sum(credit) / count(nll), 6) AS accuracy_covered FROM scored GROUP BY system")
def coverage_policy(t: Tables) -> DataFrame:
    """Missing answers are wrong for accuracy and absent for NLL; two populations of NLL are named apart."""
    return scored(t).groupBy("system").agg(
        F.count("*").alias("planned"), F.count("nll").alias("covered"), F.round(F.avg("nll"), 6).alias("nll_covered"), F.round(F.avg(F.when(F.col("family") != "en", F.col("nll"))), 6).alias("nll_other"),
        F.round(F.sum("credit") / F.count("*"), 6).alias("accuracy_planned"), F.round(F.sum("credit") / F.count("nll"), 6).alias("accuracy_covered"),
    )


_GRID = "g AS (SELECT k.k::bigint AS step, pow(10.0::double, -1 + k.k * 2.0::double / 120) AS t FROM range(121) k(k))"


@query(f"""WITH {LOGITS}, {_GRID}, u AS (SELECT g.step, g.t, z.doc_id, z.system, z.family, z.i, z.target, (z.z - m.mz) / g.t AS x FROM z JOIN (SELECT doc_id, system, max(z) AS mz FROM z GROUP BY ALL) m USING (doc_id, system), g),
n AS (SELECT step, t, doc_id, system, family, ln(sum(exp(x))) - sum(CASE WHEN i = target THEN x ELSE 0 END) AS nll FROM u GROUP BY ALL),
f AS (SELECT system, step, t, family, avg(nll) AS nll FROM n GROUP BY ALL), l AS (SELECT system, step, t, round(avg(nll), 9) AS loss FROM f GROUP BY ALL)
SELECT system, step, round(t, 6) AS t, round(loss, 6) AS loss FROM l QUALIFY row_number() OVER (PARTITION BY system ORDER BY loss, step) = 1""")
def temperature_fit(t: Tables) -> DataFrame:
    return C.fit_temperature(logits(t).where("logits IS NOT NULL")).select("system", "step", F.round("t", 6).alias("t"), F.round("loss", 6).alias("loss"))


_BOOT = f"""cl AS (SELECT family, source AS cluster, system, sum(credit) AS credit, count(*) AS n FROM scored GROUP BY ALL),
pl AS (SELECT family, cluster, row_number() OVER (PARTITION BY family ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY family) AS clusters FROM (SELECT DISTINCT family, cluster FROM cl)),
sl AS (SELECT f.family, r.r AS replicate, s.s AS slot, f.clusters FROM (SELECT DISTINCT family, clusters FROM pl) f, range(200) r(r), range(64) s(s) WHERE s.s < f.clusters),
dr AS (SELECT family, replicate, {h("'boot:'||family||':'||replicate||':'||slot", 8)} % clusters AS place FROM sl),
rp AS (SELECT d.replicate, d.family, c.system, sum(c.credit) / sum(c.n) AS accuracy FROM dr d JOIN pl p ON p.family = d.family AND p.place = d.place JOIN cl c ON c.family = p.family AND c.cluster = p.cluster GROUP BY ALL)"""


@query(f"""WITH {LOGITS}, {_BOOT}, m AS (SELECT replicate, system, avg(accuracy) AS a FROM rp GROUP BY ALL), g AS (SELECT replicate, max(a) FILTER (system = 'b') - max(a) FILTER (system <> 'b') AS gain FROM m GROUP BY replicate)
SELECT count(*) AS replicates, round(avg(gain), 6) AS mean_gain, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high FROM g""")
def paired_bootstrap_ci(t: Tables) -> DataFrame:
    reps = B.replicates(B.cluster_sums(scored(t), "source"), 200, "boot")
    return B.gain_interval(reps, "b").select("replicates", *(F.round(c, 6).alias(c) for c in ("mean_gain", "low", "high")))


@query(f"""WITH {LOGITS}, {METRICS} SELECT x.family, round((y.accuracy - x.accuracy) * 100, 6) AS delta_points, CASE WHEN y.accuracy - x.accuracy > 1e-9 THEN 'improved' WHEN y.accuracy - x.accuracy < -1e-9 THEN 'regressed' ELSE 'same' END AS change FROM metrics x JOIN metrics y USING (family) WHERE x.system = 'a' AND y.system = 'b'""")
def metric_deltas(t: Tables) -> DataFrame:
    m = C.family_metrics(scored(t), ["system", "family"])
    both = m.where("system = 'a'").select("family", F.col("accuracy").alias("x")).join(m.where("system = 'b'").select("family", F.col("accuracy").alias("y")), "family")
    d = F.col("y") - F.col("x")
    return both.select("family", F.round(d * 100, 6).alias("delta_points"), F.when(d > 1e-9, "improved").when(d < -1e-9, "regressed").otherwise("same").alias("change"))


_GAIN = "gm AS (SELECT replicate, system, avg(accuracy) AS a FROM rp GROUP BY ALL), gg AS (SELECT replicate, max(a) FILTER (system = 'b') - max(a) FILTER (system <> 'b') AS gain FROM gm GROUP BY replicate), gi AS (SELECT quantile_cont(gain, 0.025) AS low FROM gg)"


@query(f"""WITH {LOGITS}, {METRICS}, {MACRO}, {_BOOT}, {_GAIN}
SELECT system, macro_accuracy >= 0.4 AS accuracy_ok, macro_coverage >= 0.95 AS coverage_ok, CASE WHEN system = 'b' THEN low > 0 ELSE false END AS interval_ok, macro_accuracy >= 0.4 AND macro_coverage >= 0.95 AND system = 'b' AND low > 0 AS qualified FROM macro, gi""")
def release_gate(t: Tables) -> DataFrame:
    """Accuracy, coverage, and a paired interval above zero: only the selected system has one against the best other."""
    s = scored(t)
    interval = B.gain_interval(B.replicates(B.cluster_sums(s, "source"), 200, "boot"), "b").select((F.col("low") > 0).alias("above"))  # one row
    g = V.gates(C.macro(C.family_metrics(s, ["system", "family"]), ["system"]), 0.4, 0.95).join(F.broadcast(interval))
    ok = (F.col("system") == "b") & F.col("above")
    return g.select("system", "accuracy_ok", "coverage_ok", ok.alias("interval_ok"), (F.col("qualified") & ok).alias("qualified"))


@query(f"""WITH {LOGITS}, {METRICS}, {MACRO}, {_BOOT}, {_GAIN}, d AS (SELECT y.family, y.accuracy - x.accuracy AS delta FROM metrics x JOIN metrics y USING (family) WHERE x.system = 'a' AND y.system = 'b'),
c AS (SELECT (SELECT macro_accuracy FROM macro WHERE system = 'b') - (SELECT macro_accuracy FROM macro WHERE system = 'a') >= 0.1 - 1e-12 AS gain_ten_points, (SELECT low > 0 FROM gi) AS interval_above_zero, (SELECT count(*) FILTER (delta > 0) >= 3 FROM d) AS three_families_improve,
(SELECT count(*) FILTER (delta < -0.03 - 1e-12) = 0 FROM d) AS no_family_regresses, (SELECT macro_coverage >= 0.95 FROM macro WHERE system = 'b') AS coverage_ok, (SELECT count(DISTINCT sha256({NORM})) >= 100 FROM documents) AS enough_groups, (SELECT count(*) >= 3 FROM d) AS enough_families)
SELECT *, gain_ten_points AND interval_above_zero AND three_families_improve AND no_family_regresses AND coverage_ok AND enough_groups AND enough_families AS passed FROM c""")
def historical_gate(t: Tables) -> DataFrame:
    """The earlier gate: one row with each check and whether all hold, for system b against a."""
    s = scored(t)
    m = C.family_metrics(s, ["system", "family"])
    whole = C.macro(m, ["system"]).agg(*(F.max(F.when(F.col("system") == x, F.col(f"macro_{c}"))).alias(f"{c}_{x}") for x in "ab" for c in ("accuracy", "coverage")))
    delta = F.max(F.when(F.col("system") == "b", F.col("accuracy"))) - F.max(F.when(F.col("system") == "a", F.col("accuracy")))
    families = m.groupBy("family").agg(delta.alias("delta")).agg(F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < -0.03 - 1e-12).alias("down"), F.count("*").alias("families"))
    interval = B.gain_interval(B.replicates(B.cluster_sums(s, "source"), 200, "boot"), "b").select("low")
    groups = t.documents.select(X.norm(F.col("text")).alias("norm")).distinct().agg(F.count("*").alias("groups"))
    one = whole.join(families).join(interval).join(groups)  # four tables of one row
    checks = {
        "gain_ten_points": F.col("accuracy_b") - F.col("accuracy_a") >= 0.1 - 1e-12, "interval_above_zero": F.col("low") > 0, "three_families_improve": F.col("up") >= 3, "no_family_regresses": F.col("down") == 0,
        "coverage_ok": F.col("coverage_b") >= 0.95, "enough_groups": F.col("groups") >= 100, "enough_families": F.col("families") >= 3,
    }
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return one.select(*(c.alias(k) for k, c in checks.items()), passed.alias("passed"))


_BY_SOURCE = _BOOT.replace("SELECT family, source AS cluster", "SELECT source AS family, sha256(doc_id % 40 || '') AS cluster").replace("range(200)", "range(1000)").replace("'boot:'", "'strata:'")


@query(f"""WITH {LOGITS}, {_BY_SOURCE}, m AS (SELECT replicate, system, avg(accuracy) AS a FROM rp GROUP BY ALL), g AS (SELECT replicate, max(a) FILTER (system = 'b') - max(a) FILTER (system <> 'b') AS gain FROM m GROUP BY replicate)
SELECT count(*) AS replicates, round(avg(gain), 9) AS mean_gain, round(quantile_cont(gain, 0.025), 9) AS low, round(quantile_cont(gain, 0.975), 9) AS high FROM g""")
def bootstrap_by_source(t: Tables) -> DataFrame:
    """The earlier interval: 1,000 replicates, groups of rows drawn within each source, the mean of the sources' means."""
    grouped = scored(t).drop("family").withColumn("family", F.col("source")).withColumn("cluster", F.sha2((D() % 40).cast("string"), 256))
    reps = B.replicates(B.cluster_sums(grouped, "cluster"), 1000, "strata")
    return B.gain_interval(reps, "b").select("replicates", *(F.round(c, 9).alias(c) for c in ("mean_gain", "low", "high")))


_GRID2 = "g AS (SELECT k.k::bigint AS step, pow(10.0::double, -1 + k.k * 2.0::double / 160) AS t FROM range(161) k(k))"


@query(f"""WITH {LOGITS}, {_GRID2}, u AS (SELECT g.step, g.t, z.doc_id, z.source, z.i, z.target, (z.z - m.mz) / g.t AS x FROM z JOIN (SELECT doc_id, system, max(z) AS mz FROM z GROUP BY ALL) m USING (doc_id, system), g WHERE system = 'b'),
n AS (SELECT step, t, doc_id, source, ln(sum(exp(x))) - sum(CASE WHEN i = target THEN x ELSE 0 END) AS nll FROM u GROUP BY ALL), l AS (SELECT source, step, t, round(avg(nll), 9) AS loss FROM n GROUP BY ALL)
SELECT source, step, round(t, 6) AS t, round(loss, 6) AS loss FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY loss, step) = 1""")
def temperature_by_source(t: Tables) -> DataFrame:
    """The earlier fit: a temperature for each source, on a grid of 161."""
    r = logits(t).where("logits IS NOT NULL AND system = 'b'").drop("system", "family").withColumn("system", F.col("source")).withColumn("family", F.lit("all"))
    return C.fit_temperature(r, 161).select(F.col("system").alias("source"), "step", F.round("t", 6).alias("t"), F.round("loss", 6).alias("loss"))


_SOFT = "CASE doc_id % 4 WHEN 0 THEN [0.1, 0.2, 0.3, 0.4]::double[] WHEN 1 THEN [0.25, 0.25, 0.25, 0.3]::double[] END"


@query(f"""WITH {LOGITS}, x AS (SELECT lp.doc_id, lp.system, lp.target, lp.i, lp.z, lp.mz, lp.logp, {_SOFT.replace("doc_id", "lp.doc_id")} AS soft FROM lp), p AS (SELECT *, CASE WHEN soft IS NULL OR doc_id % 4 = 1 THEN (i = target)::int::double ELSE soft[i + 1] END AS p FROM x)
SELECT doc_id, system, CASE WHEN doc_id % 4 = 1 THEN 'sum' END AS error, round(avg(CASE WHEN z = mz THEN p END), 6) AS credit, round(-sum(CASE WHEN p > 0 THEN p * logp ELSE 0 END), 6) AS nll, round(sum((exp(logp) - p) * (exp(logp) - p)), 6) AS brier FROM p GROUP BY doc_id, system""")
def soft_target_scores(t: Tables) -> DataFrame:
    """Scores where some rows have soft targets; a soft target that is no distribution is named, and the hard one used."""
    probs = F.when(D() % 4 == 0, F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))).when(D() % 4 == 1, F.array(*map(F.lit, (0.25, 0.25, 0.25, 0.3))))
    r = logits(t).where("logits IS NOT NULL").withColumn("given", probs).withColumn("error", C.target_error(F.col("given"), F.col("n")))
    r = r.withColumn("target_probs", F.when(F.col("error").isNull(), F.col("given")))
    return C.scored(r).select("doc_id", "system", "error", *(F.round(c, 6).alias(c) for c in ("credit", "nll", "brier")))


@query(f"""WITH {LOGITS}, e AS (SELECT doc_id, system, i, exp((z - max(z) OVER w) / 4.1368) AS e, z, mz FROM z JOIN (SELECT doc_id, system, max(z) AS mz FROM z GROUP BY ALL) m USING (doc_id, system) WINDOW w AS (PARTITION BY doc_id, system)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, system) AS p FROM e)
SELECT doc_id, system, CASE doc_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS kind, CASE WHEN doc_id % 3 = 0 THEN min(CASE WHEN z = mz THEN i END)::varchar END AS choice,
round(CASE doc_id % 3 WHEN 1 THEN sum(i * p) WHEN 2 THEN max(CASE WHEN i = 1 THEN p END) END, 5) AS value, round(CASE WHEN doc_id % 3 <> 2 THEN max(p) END, 5) AS top FROM p GROUP BY doc_id, system""")
def served_answers(t: Tables) -> DataFrame:
    """Answers as they are served, at the fixed temperature 4.1368: a choice, an expected level, or the chance of yes; no confidence."""
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (D() % 3 + 1).cast("int"))
    r = logits(t).where("logits IS NOT NULL").select("doc_id", "system", kind.alias("kind"), R.served(kind, F.array(*map(F.lit, ("0", "1", "2", "3"))), F.col("logits"), F.lit(1), 4.1368).alias("a"))
    return r.select("doc_id", "system", "kind", "a.choice", F.round("a.value", 5).alias("value"), F.round(F.array_max("a.probabilities"), 5).alias("top"))


@query("""SELECT event_id, q.qid, sha256(trim(event_type)||CASE WHEN q.qid = 'decision' THEN chr(10)||chr(10)||'What happened?' ELSE '' END) AS state_hash, k.key, k.text, k.place FROM events, (VALUES ('decision'), ('true')) q(qid), (VALUES ('decision', 'buy', 'A purchase', 0), ('decision', 'other', 'other', 1), ('true', 'false', 'No, this is false.', 0), ('true', 'true', 'Yes, this is true.', 1)) k(of, key, text, place) WHERE k.of = q.qid""")
def question_pairs(t: Tables) -> DataFrame:
    """Every question of every event with its state text and candidates: one row a question and candidate."""
    pair = lambda k, x: F.struct(F.lit(k).alias("key"), F.lit(x).alias("text"))
    none = F.lit(None).cast("array<struct<key:string,text:string>>")
    ask = lambda qid, kind, text, c: F.struct(F.lit(qid).alias("qid"), F.lit(kind).alias("kind"), F.lit(text).cast("string").alias("instructions"), c.alias("criteria"))
    questions = F.array(ask("decision", "choice", "What happened?", F.array(pair("buy", "A purchase"), pair("other", " "))), ask("true", "noul", None, none))
    p = R.pairs(t.events.select("event_id", F.col("event_type").alias("state"), questions.alias("questions")), "event_id")
    return p.select("event_id", "qid", F.sha2("state_text", 256).alias("state_hash"), "key", "text", "place")


@query(f"WITH {LOGITS}, {METRICS}, {MACRO} SELECT system, row_number() OVER (ORDER BY -macro_accuracy, macro_nll)::int AS place, printf('%.2f%%', macro_accuracy * 100) AS accuracy, printf('%+.2f pp', (macro_accuracy - 0.25) * 100) AS over_chance FROM macro")
def system_order(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window as W

    m = C.macro(C.family_metrics(scored(t), ["system", "family"]), ["system"])
    return m.select("system", F.row_number().over(W.orderBy(-F.col("macro_accuracy"), "macro_nll")).alias("place"), X.percent(F.col("macro_accuracy")).alias("accuracy"), X.points(F.col("macro_accuracy") - 0.25).alias("over_chance"))


_LONGEST = "coalesce(list_max(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: length(x))), 0)"


def sized(t: Tables) -> DataFrame:
    """Scores with the size of the state (characters) and of the largest candidate (here the longest word)."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(f"({X.WORD})"), 1), F.length)), F.lit(0))
    return scored(t).join(t.documents.select("doc_id", "n_chars", longest.alias("longest")), "doc_id")


@query(f"""WITH {LOGITS}, b AS (SELECT s.*, d.n_chars, {_LONGEST} AS longest FROM scored s JOIN documents d USING (doc_id)), x AS (SELECT system, credit, unnest(list_filter([CASE WHEN n_chars < 1000 AND longest <= 16 THEN 'short' END, CASE WHEN n_chars >= 1000 OR longest > 16 THEN 'long' END, CASE WHEN n_chars > 4000 THEN 'state_over' END, CASE WHEN longest > 16 THEN 'candidate_over' END], lambda v: v IS NOT NULL)) AS bucket FROM b)
SELECT system, bucket, count(*) AS rows, round(avg(credit), 6) AS accuracy FROM x GROUP BY ALL""")
def length_buckets(t: Tables) -> DataFrame:
    """Overlapping buckets of states and candidates."""
    big, wide = F.col("n_chars") >= 1000, F.col("longest") > 16
    names = V.error_codes([("short", ~big & ~wide), ("long", big | wide), ("state_over", F.col("n_chars") > 4000), ("candidate_over", wide)])
    return sized(t).select("system", "credit", F.explode(names).alias("bucket")).groupBy("system", "bucket").agg(F.count("*").alias("rows"), F.round(F.avg("credit"), 6).alias("accuracy"))


@query(f"""WITH {LOGITS}, b AS (SELECT s.*, d.n_chars, {_LONGEST} AS longest FROM scored s JOIN documents d USING (doc_id) WHERE s.nll IS NOT NULL), c(cap) AS (VALUES (500), (2000), (8000)), k(candidate_cap) AS (VALUES (14), (18))
SELECT system, cap, candidate_cap, count(*) AS rows, count(*) FILTER (n_chars > cap OR longest > candidate_cap) AS rejected, round(avg(CASE WHEN n_chars > cap OR longest > candidate_cap THEN 0 ELSE credit END), 6) AS accuracy FROM b, c, k GROUP BY ALL""")
def cap_policy_grid(t: Tables) -> DataFrame:
    """Three caps for states by two for candidates: what is over one counts as wrong, what was not measured does not count."""
    grid = F.array(*(F.struct(F.lit(s).alias("cap"), F.lit(c).alias("candidate_cap")) for s in (500, 2000, 8000) for c in (14, 18)))
    b = sized(t).where("nll IS NOT NULL").withColumn("g", F.explode(grid)).select("*", "g.*")
    over = (F.col("n_chars") > F.col("cap")) | (F.col("longest") > F.col("candidate_cap"))
    return b.groupBy("system", "cap", "candidate_cap").agg(F.count("*").alias("rows"), F.count_if(over).alias("rejected"), F.round(F.avg(F.when(over, 0.0).otherwise(F.col("credit"))), 6).alias("accuracy"))


@query(f"""WITH {LOGITS} SELECT doc_id, system, CASE doc_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS kind,
CASE WHEN doc_id % 3 = 2 THEN CASE WHEN p1 >= 0.5 THEN 'true' ELSE 'false' END ELSE best::varchar END AS label, round(CASE doc_id % 3 WHEN 0 THEN top WHEN 1 THEN expected ELSE p1 END, 5) AS value
FROM scored JOIN (SELECT doc_id, system, max(exp(logp)) AS top, max(exp(logp)) FILTER (i = 1) AS p1 FROM lp GROUP BY ALL) USING (doc_id, system)""")
def answer_assembly(t: Tables) -> DataFrame:
    r = logits(t).where("logits IS NOT NULL").withColumn("kind", F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (D() % 3 + 1).cast("int")))
    keys = F.when(F.col("kind") == "noul", F.array(*map(F.lit, ("false", "true", "2", "3")))).otherwise(F.array(*map(F.lit, ("0", "1", "2", "3"))))
    a = r.select("doc_id", "system", "kind", R.answer(F.col("kind"), keys, F.col("logits")).alias("a"))
    return a.select("doc_id", "system", "kind", "a.label", F.round("a.value", 5).alias("value"))


@query("""SELECT event_id, CASE user_id % 3 WHEN 0 THEN ['click','purchase','signup'] WHEN 1 THEN ['0','1','2'] ELSE ['false','true'] END[i.i+1] AS key,
CASE user_id % 3 WHEN 0 THEN ['Clicked','purchase','Signed up'] WHEN 1 THEN ['low','middle','high'] ELSE ['No, this is false.','Yes, this is true.'] END[i.i+1] AS text, i.i::int AS place FROM events, range(3) i(i) WHERE i.i < CASE WHEN user_id % 3 = 2 THEN 2 ELSE 3 END""")
def question_candidates(t: Tables) -> DataFrame:
    pair = lambda k, x: F.struct(F.lit(k).alias("key"), F.lit(x).alias("text"))
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (F.col("user_id") % 3 + 1).cast("int"))
    criteria = F.when(kind == "choice", F.array(pair("click", "Clicked"), pair("purchase", " "), pair("signup", "Signed up"))).when(kind == "score", F.array(pair("", "low"), pair("", "middle"), pair("", "high")))
    e = t.events.select("event_id", F.posexplode(R.candidates(kind, criteria)).alias("place", "c"))
    return e.select("event_id", "c.key", "c.text", "place")


@query("""WITH c AS (SELECT l_orderkey, list(l_shipdate::varchar||l_returnflag||l_linestatus) AS t FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(t) < 2 THEN 'too few' WHEN len(t) > 64 THEN 'too many' WHEN len(list_distinct(t)) < len(t) THEN 'repeated' END AS error FROM (SELECT l_orderkey, list(l_returnflag||l_linestatus) AS t FROM lineitem GROUP BY l_orderkey)""")
def candidate_constraints(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("t"))
    return c.select("l_orderkey", R.candidate_error(F.col("t")).alias("error"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::int AS rank FROM events QUALIFY rank <= 10")
def stable_rank(t: Tables) -> DataFrame:
    return R.stable_rank(t.events.select("user_id", "event_id", "value"), "user_id", "value", "event_id").where("rank <= 10").select("user_id", "event_id", "rank")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT q.vec_id AS "query", v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) AS cosine FROM embeddings v JOIN q ON v.vec_id <> q.vec_id)
SELECT "query", vec_id, cosine, row_number() OVER (PARTITION BY "query" ORDER BY cosine DESC, vec_id)::int AS rank FROM n QUALIFY rank <= 5""")
def cosine_topk(t: Tables) -> DataFrame:
    return Vec.nearest_to(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 5).select("query", "vec_id", "cosine", "rank")


@query("""WITH e AS (SELECT vec_id, vec_id // 25 AS batch, label AS state_key, vec_id % 7 AS action_key, vec_id % 5 AS grp, embedding::double[] AS s, list_reverse(embedding)::double[] AS a FROM embeddings),
p AS (SELECT x.batch, x.vec_id AS i, y.vec_id AS j, coalesce(x.state_key = y.state_key, false) OR x.action_key = y.action_key OR x.vec_id = y.vec_id AS positive, x.grp = y.grp AS same, list_cosine_similarity(x.s, y.a) / 0.07 AS z FROM e x JOIN e y USING (batch)),
r AS (SELECT batch, i, ln(sum(exp(z)) FILTER (positive OR NOT same)) - ln(sum(exp(z)) FILTER (positive)) AS loss FROM p GROUP BY ALL), c AS (SELECT batch, j, ln(sum(exp(z)) FILTER (positive OR NOT same)) - ln(sum(exp(z)) FILTER (positive)) AS loss FROM p GROUP BY ALL)
SELECT batch, round((avg(r.loss) + (SELECT avg(loss) FROM c WHERE c.batch = r.batch)) / 2, 4) AS loss, count(*) AS rows FROM r GROUP BY batch""")
def masked_contrastive_loss(t: Tables) -> DataFrame:
    """Batches of 25; a vector read backwards stands for the action, the label and a remainder for the keys."""
    e = t.embeddings.select(F.expr("vec_id div 25").alias("batch"), F.col("vec_id").alias("id"), F.col("embedding").alias("state"), F.reverse("embedding").alias("action"), F.col("label").alias("state_key"), (F.col("vec_id") % 7).alias("action_key"), (F.col("vec_id") % 5).alias("group"))
    return Vec.contrastive_loss(e, "batch", block=8).select("batch", F.round("loss", 4).alias("loss"), "rows")


@query("""WITH n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS norm FROM embeddings)
SELECT vec_id, label, round(norm, 5) AS norm, len(embedding)::int AS dims, round(embedding[1]::double / norm, 5) AS first, round(embedding[len(embedding)]::double / norm, 5) AS last, round(list_sum(list_transform(embedding, lambda x: (x::double / norm) * (x::double / norm))), 5) AS unit FROM n""")
def vector_norms(t: Tables) -> DataFrame:
    """Norms, and the unit vectors: their ends and their length."""
    v = t.embeddings.withColumn("u", Vec.normalised(F.col("embedding")))
    return v.select("vec_id", "label", F.round(F.sqrt(Vec.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.size("embedding").alias("dims"), F.round(F.element_at("u", 1), 5).alias("first"), F.round(F.element_at("u", -1), 5).alias("last"), F.round(Vec.dot(F.col("u"), F.col("u")), 5).alias("unit"))
