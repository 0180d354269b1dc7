"""Queries that check predictions and put rankings into the order of the request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predictions as P
from ..registry import Tables, query


@query("""WITH p AS (SELECT l_orderkey AS id, l_returnflag AS status FROM lineitem WHERE l_quantity > 30), owed AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P')
SELECT 'duplicate' AS code, (SELECT count(*) - count(DISTINCT id) FROM p)::bigint AS n
UNION ALL SELECT 'illegal', (SELECT count(*) FROM p WHERE status NOT IN ('A', 'N'))
UNION ALL SELECT 'missing', (SELECT count(*) FROM owed WHERE id NOT IN (SELECT id FROM p))
UNION ALL SELECT 'unknown', (SELECT count(DISTINCT id) FROM p WHERE id NOT IN (SELECT id FROM owed))""")
def publication_issues(t: Tables) -> DataFrame:
    given = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("status"))
    return P.publication_issues(given, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), "id", "status", ["A", "N"])


@query("""WITH g AS (SELECT l_orderkey, count(*) AS width, count_if(l_quantity >= 50) AS endless FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN width IS NULL OR o_orderkey % 11 = 0 THEN CASE WHEN o_orderstatus <> 'P' THEN 'absent' END
  WHEN width <> o_orderkey % 4 + 1 THEN 'width' WHEN endless > 0 THEN 'finite' END AS error
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def shape_check(t: Tables) -> DataFrame:
    z = F.when(F.col("l_quantity") >= 50, float("nan")).otherwise(F.col("l_tax").cast("double"))
    given = t.lineitem.where("l_orderkey % 11 <> 0").groupBy("l_orderkey").agg(F.collect_list(z).alias("logits"))
    rows = t.orders.join(given, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", P.shape_error(F.col("logits"), F.col("o_orderkey") % 4 + 1, F.col("o_orderstatus") != "P").alias("error"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS l, max(l_quantity)::double / 10 AS z FROM lineitem GROUP BY ALL),
e AS (SELECT k, l, CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 17 = 0 THEN 'duplicate' WHEN k % 19 = 0 THEN 'non-finite' END AS error, z - max(z) OVER (PARTITION BY k) AS d FROM x)
SELECT k AS l_orderkey, error, CASE WHEN error IS NULL THEN round(sum(l * exp(d)) / sum(exp(d)), 6) END AS mean_label FROM e GROUP BY k, error""")
def ranking_probs(t: Tables) -> DataFrame:
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("label")).agg((F.max("l_quantity").cast("double") / 10).alias("score"))
    rows = x.groupBy("k").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.sort_array(F.collect_list(F.struct("score", "label")), asc=False).alias("ranked"))
    first = F.get("labels", F.lit(0))
    # rankings that lack the first label, have it twice, or have no finite score for it
    ranking = (
        F.when(F.col("k") % 13 == 0, F.filter("ranked", lambda r: r["label"] != first))
        .when(F.col("k") % 17 == 0, F.concat(F.col("ranked"), F.filter("ranked", lambda r: r["label"] == first)))
        .when(F.col("k") % 19 == 0, F.transform("ranked", lambda r: F.struct(F.when(r["label"] == first, float("nan")).otherwise(r["score"]).alias("score"), r["label"].alias("label"))))
        .otherwise(F.col("ranked"))
    )
    got = rows.select("k", "labels", P.label_probs(F.col("labels"), ranking).alias("got"))
    mean = F.aggregate(F.zip_with("labels", "got.probs", lambda w, p: w * p), F.lit(0.0), lambda s, v: s + v)
    return got.select(F.col("k").alias("l_orderkey"), F.col("got.error").alias("error"), F.round(mean, 6).alias("mean_label"))
