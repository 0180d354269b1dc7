"""Queries over the star schema and events: joins, denominators, tiers, ledgers, percentiles, rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import preparation as P
from ..operators import ranks as Rk
from ..registry import Tables, query
from .sql import NORM


@query("""SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def dictionary_join(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT count(*) AS parts, sum(p_partkey)::bigint AS keys FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def referenced_semi_join(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").agg(F.count("*").alias("parts"), F.sum("p_partkey").alias("keys"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 5000").select("c_custkey").subtract(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09 UNION SELECT p_partkey FROM part WHERE p_size > 45")
def set_union(t: Tables) -> DataFrame:
    return t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("k")).union(t.part.where("p_size > 45").select(F.col("p_partkey").alias("k"))).distinct()


_PLAN = """p AS (SELECT o_orderkey, o_orderpriority AS tier, o_orderstatus <> 'P' AS scorable FROM orders), a AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY l_orderkey), j AS (SELECT * FROM p LEFT JOIN a ON l_orderkey = o_orderkey)"""
_COUNTS = "count(*) AS planned, count(*) FILTER (scorable) AS scorable, count(n) AS attempted, count(*) FILTER (n IS NULL) AS unattempted, count(*) FILTER (bad) AS invalid, round(count(*) FILTER (n IS NOT NULL AND NOT bad)::double / count(*), 6) AS accuracy"


def _denominators():
    good = F.col("n").isNotNull() & ~F.col("bad")
    return [
        F.count("*").alias("planned"), F.count_if(F.col("scorable")).alias("scorable"), F.count("n").alias("attempted"), F.count_if(F.col("n").isNull()).alias("unattempted"),
        F.count_if(F.col("bad")).alias("invalid"), F.round(F.count_if(good) / F.count("*"), 6).alias("accuracy"),
    ]


def _planned(t: Tables) -> DataFrame:
    plan = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("tier"), (F.col("o_orderstatus") != "P").alias("scorable"))
    tried = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("bad"))
    return plan.join(tried, plan["o_orderkey"] == tried["l_orderkey"], "left")


@query(f"WITH {_PLAN} SELECT {_COUNTS} FROM j")
def plan_denominators(t: Tables) -> DataFrame:
    return _planned(t).agg(*_denominators())


@query(f"WITH {_PLAN} SELECT CASE WHEN GROUPING(tier) = 1 THEN 'all' ELSE 'tier' END AS scope, tier, {_COUNTS} FROM j GROUP BY GROUPING SETS ((tier), ())")
def tier_report(t: Tables) -> DataFrame:
    """By tier, and over all; rows without a tier are a tier of their own (null)."""
    return _planned(t).rollup("tier").agg(*_denominators(), F.grouping("tier").alias("whole")).select(F.when(F.col("whole") == 1, "all").otherwise("tier").alias("scope"), "*").drop("whole")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unattempted(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(t: Tables) -> DataFrame:
    return Rk.percentiles(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95}).select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT o_orderpriority AS tier, round(sum(l_quantity) / sum(l_tax + 1), 6) AS per_second, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def throughput_by_tier(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("tier"), "l_quantity", "l_tax")
    rates = j.groupBy("tier").agg(F.round(F.sum("l_quantity") / F.sum(F.col("l_tax") + 1), 6).alias("per_second"))
    return rates.join(Rk.percentiles(j, "tier", "l_quantity", {"median": 0.5}), "tier").select("tier", "per_second", F.round("median", 6).alias("median"))


@query("""WITH c AS (SELECT event_type, user_id % 5 AS round, CASE WHEN event_type = 'error' THEN 2.0::double ELSE value END + 0.5 AS cost FROM events)
SELECT event_type, round, round(sum(cost), 4) AS spent, sum(cost) > 5000 AS over_cap, (SELECT sum(cost) > 30000 FROM c x WHERE x.round = c.round) AS round_over, (SELECT sum(cost) > 100000 FROM c) AS project_over FROM c GROUP BY event_type, round""")
def ledger_caps(t: Tables) -> DataFrame:
    """Estimated cost, or what is reserved where there is no estimate, plus overhead: by group, and whether group, round and project are over their caps."""
    estimate = F.when(F.col("event_type") != "error", F.col("value"))
    c = t.events.select("event_type", (F.col("user_id") % 5).alias("round"), (F.coalesce(estimate, F.lit(2.0)) + 0.5).alias("cost"))
    groups = c.groupBy("event_type", "round").agg(F.sum("cost").alias("cost"))  # rounds and the project are sums of these few rows
    rounds = groups.groupBy("round").agg((F.sum("cost") > 30_000).alias("round_over"))
    project = groups.agg((F.sum("cost") > 100_000).alias("project_over"))
    return groups.join(rounds, "round").join(F.broadcast(project)).select("event_type", "round", F.round("cost", 4).alias("spent"), (F.col("cost") > 5000).alias("over_cap"), "round_over", "project_over")


@query("SELECT p_brand, arg_min(p_partkey, (p_size, p_retailprice, p_partkey)) AS chosen, count(*) AS eligible FROM part WHERE p_retailprice < 1500 GROUP BY p_brand")
def argmin_composite(t: Tables) -> DataFrame:
    return t.part.where("p_retailprice < 1500").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_retailprice", "p_partkey")).alias("chosen"), F.count("*").alias("eligible"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus IN ('O') AND l_returnflag IN ('N','R') GROUP BY 1")
def value_set_filter(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_linestatus").isin("O") & F.col("l_returnflag").isin("N", "R")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice > 200000 THEN 1 END AS target FROM orders)
SELECT o_orderkey, target, CASE WHEN target IS NULL THEN '0.5,0.5' END AS probs FROM s""")
def preference_target(t: Tables) -> DataFrame:
    target = F.when(F.col("o_totalprice") < 100000, 0).when(F.col("o_totalprice") > 200000, 1)
    return t.orders.select("o_orderkey", target.alias("target"), F.when(target.isNull(), "0.5,0.5").alias("probs"))


@query("""WITH r AS (SELECT event_id, (value - floor(value / 4) * 4)::double AS x FROM events)
SELECT event_id, round(list_sum(list_transform(range(5), lambda i: greatest(0, 1 - abs(x - i)) * i)), 5) AS mean, round_even(x, 0)::int AS target FROM r""")
def ordinal_soft_label(t: Tables) -> DataFrame:
    """Mass on the floor and the ceiling of a rating; the target is the half-even rounding."""
    x = F.col("value") - F.floor(F.col("value") / 4) * 4
    soft = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.greatest(F.lit(0.0), 1 - F.abs(x - i)) * i)
    return t.events.select("event_id", F.round(F.aggregate(soft, F.lit(0.0), lambda a, b: a + b), 5).alias("mean"), F.bround(x, 0).cast("int").alias("target"))


@query("""WITH s AS (SELECT o_orderkey AS id, ('0x'||substr(sha256('rule:a:'||o_orderkey),1,8))::bigint % 24 AS a, ('0x'||substr(sha256('rule:b:'||o_orderkey),1,8))::bigint % 24 AS b, o_orderpriority AS p FROM orders)
SELECT id, 'Order '||id||' ('||p||') starts at '||a||' and is due at '||b||'.' AS state, (b > a)::int AS target FROM s""")
def synthetic_rules(t: Tables) -> DataFrame:
    """A rule text for each order, with hours from hashes of its key; the label is computed apart from the text and holds by construction."""
    draw = lambda tag: X.bucket(X.sha("rule", tag, F.col("id")), 8, 24)
    s = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority").withColumn("a", draw("a")).withColumn("b", draw("b"))
    return s.select("id", F.format_string("Order %d (%s) starts at %d and is due at %d.", "id", "o_orderpriority", "a", "b").alias("state"), (F.col("b") > F.col("a")).cast("int").alias("target"))


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, len(json_keys(props))::int AS keys FROM events")
def json_props(t: Tables) -> DataFrame:
    keys = F.json_object_keys("props")
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(m, F.element_at(keys, 1)).alias("first_value"), F.size(keys).alias("keys"))


@query(f"""WITH p AS (SELECT role, text AS positive, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS negative FROM conversations),
i AS (SELECT role, CASE WHEN positive IS NULL OR trim(positive) = '' THEN 'blank' WHEN {NORM.replace("text", "positive")} = {NORM.replace("text", "coalesce(negative, '')")} THEN 'same' END AS issue FROM p)
SELECT role, count(*) FILTER (issue IS NULL) AS valid, count(*) FILTER (issue = 'blank') AS blank, count(*) FILTER (issue = 'same') AS same FROM i GROUP BY role""")
def pair_validity(t: Tables) -> DataFrame:
    """Each turn with the one before it as its negative: how many pairs are valid, and why the others are set aside."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    p = t.conversations.select("role", "text", before.alias("negative")).withColumn("issue", P.pair_issue(F.col("text"), F.col("negative"), X.norm))
    return p.groupBy("role").agg(F.count_if(F.col("issue").isNull()).alias("valid"), *(F.count_if(F.col("issue") == k).alias(k) for k in ("blank", "same")))


@query("""SELECT l_orderkey, l_linenumber, (list_position(labels, l_returnflag||l_linestatus) - 1)::int AS choice, len(labels)::int AS choices FROM lineitem JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag||l_linestatus)) AS labels FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)""")
def choice_lookup(t: Tables) -> DataFrame:
    """The place of each line's own answer among the labels of its order."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("answer"))
    labels = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("answer")).alias("labels"))  # an order has a few lines
    return lines.join(labels, "l_orderkey").select("l_orderkey", "l_linenumber", (F.array_position("labels", F.col("answer")) - 1).cast("int").alias("choice"), F.size("labels").alias("choices"))
