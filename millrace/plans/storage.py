"""Queries that write and read again: token arrays, frozen recipes, vectors by content, scoring heads."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import embedding_cache as E
from ..operators import freeze as Z
from ..operators import heads as H
from ..functions.letters import letter_counts
from ..operators.near import own_folder
from ..registry import Tables, query
from ..sources import csr
from .sql import LOGITS, digest_sql


@query("""SELECT doc_id AS id, len(w)::int AS n_tokens, (sum(len(w)) OVER (ORDER BY doc_id) - len(w))::bigint AS start, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS total, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::int AS longest
FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents)""")
def csr_round_trip(t: Tables) -> DataFrame:
    """Arrays (here the lengths of each document's words) written as flat files in order of id, and read back with their offsets."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(f"({X.WORD})"), 1), F.length)
    path = own_folder(t.spark, "csr")
    csr.write_csr(t.documents.select(F.col("doc_id").alias("id"), lengths.alias("tokens")), path)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return csr.read_csr(t.spark, path).select("id", F.size("tokens").alias("n_tokens"), "start", total.alias("total"), F.coalesce(F.array_max("tokens"), F.lit(0)).alias("longest"))


_LIMITS = {"candidate_tokens": 768, "state_tokens": 2048}


@query("\nUNION ALL ".join(f"SELECT 'table' AS kind, '{name}' AS name, {digest_sql(name, columns)}" for name, columns in (("benchmark", ["item_id", "text"]), ("conversations", ["conv_id", "role", "text", "turn"]), ("documents", ["doc_id", "lang", "n_chars", "source", "text"])))
+ "\nUNION ALL SELECT 'limit', 'candidate_tokens', '768', NULL UNION ALL SELECT 'limit', 'rationale', 'chosen on development rows', NULL UNION ALL SELECT 'limit', 'state_tokens', '2048', NULL")
def frozen_recipe(t: Tables) -> DataFrame:
    """Three tables and two limits, frozen, found again under another partitioning, and validated when the final table is opened."""
    folder = own_folder(t.spark, "recipe")
    tables = {name: getattr(t, name) for name in ("benchmark", "conversations", "documents")}
    Z.freeze(t.spark, folder, tables, _LIMITS, "chosen on development rows")
    other = {k: v.repartition(2 * v.rdd.getNumPartitions() + 1) for k, v in tables.items()}
    if Z.freeze(t.spark, folder, other, _LIMITS, "chosen on development rows") != "reused":
        raise RuntimeError("an equal recipe was not reused")
    return Z.open_final(t.spark, folder, tables, _LIMITS)


@query("""SELECT doc_id, length(text)::int AS size, (length(text) - length(replace(text, 'a', '')))::int AS a, (length(text) - length(replace(text, 'e', '')))::int AS e, (length(text) - length(replace(text, ' ', '')))::int AS spaces,
(SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0) AS first_run, (SELECT count(DISTINCT text) FROM documents) - (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0) AS second_run, 0::bigint AS third_run FROM documents""")
def embedding_cache(t: Tables) -> DataFrame:
    """Vectors of all documents after three runs: over half of the rows, over all, and over all again; each encodes what is new."""
    folder, texts = own_folder(t.spark, "vectors"), t.documents.select("doc_id", "text")
    runs = [E.encode_missing(x, folder, letter_counts, wave=20_000) for x in (texts.where("doc_id % 2 = 0"), texts, texts)]
    v = E.embedded(texts, folder)
    at = lambda k: F.get("vector", F.lit(k)).cast("int")
    return v.select("doc_id", at(0).alias("size"), at(1).alias("a"), at(2).alias("e"), at(3).alias("spaces"), *(F.lit(n).cast("bigint").alias(f"{k}_run") for k, n in zip(("first", "second", "third"), runs)))


def table_weights(t: Tables) -> DataFrame:
    """A small head whose numbers are taken from the first vectors: four inputs, three hidden units."""
    first = t.embeddings.where("vec_id < 8").select("vec_id", F.posexplode("embedding").alias("j", "value"))
    take = lambda name, where, i, j: first.where(where).select(F.lit(name).alias("name"), F.expr(i).alias("i"), F.expr(j).alias("j"), F.col("value").cast("double").alias("value"))
    parts = [take("w1", "vec_id < 3 AND j < 4", "cast(vec_id as int)", "j"), take("b1", "vec_id = 3 AND j < 3", "0", "j"), take("w2", "vec_id = 4 AND j < 3", "0", "j"), take("b2", "vec_id = 5 AND j < 1", "0", "j"), take("gain", "vec_id = 6 AND j < 4", "0", "j"), take("bias", "vec_id = 7 AND j < 4", "0", "j")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query()
def joint_ranking(t: Tables) -> DataFrame:
    """Every document as a state with four of its words as candidates: a reason where a limit is passed, else scores and ranks."""
    # one match of up to four words, so that no text is cut into all its words
    first = functools.reduce(lambda rest, _: f"({X.WORD})(?:[^\\p{{L}}\\p{{N}}_]+{rest})?", range(3), f"({X.WORD})")
    word = lambda k: F.struct(F.lit(str(k)).alias("key"), F.nullif(F.regexp_extract("text", first, k + 1), F.lit("")).alias("text"))
    r = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("state"), F.filter(F.array(*map(word, range(4))), lambda c: c["text"].isNotNull()).alias("candidates"))
    n = lambda c: F.regexp_count(c, F.lit(X.WORD_OR_MARK))
    # white space parts the separator from both sides, so that tokens of a joint text add up, and a state is counted once
    r = r.withColumn("n_state", n(F.col("state")))
    error = H.request_error(F.col("state"), F.transform("candidates", lambda c: c["text"]), n, 2048, 768, 2100, F.col("n_state"), lambda x: F.col("n_state") + n(F.lit(H.SEPARATOR)) + n(x))
    return H.rank_joint(r, letter_counts, H.head_weights(table_weights(t)), error)


@query(f"""WITH {LOGITS}, c AS (SELECT doc_id, system, 2 + doc_id % 3 AS n, target % (2 + doc_id % 3) AS target FROM base CROSS JOIN (VALUES ('a'), ('b')) s(system)),
x AS (SELECT c.doc_id, c.system, ln(sum(exp(z.z))) - max(CASE WHEN z.i = c.target THEN z.z END) AS loss FROM c JOIN z ON z.doc_id = c.doc_id AND z.system = c.system AND z.i < c.n GROUP BY ALL)
SELECT system, round(avg(loss), 6) AS loss, count(loss) AS rows FROM x GROUP BY system""")
def candidate_cross_entropy(t: Tables) -> DataFrame:
    """Two to four candidates a row: what a row lacks has no share in its softmax."""
    from .scores import logits

    n = (F.lit(2) + F.col("doc_id") % 3).cast("int")
    r = logits(t).where("logits IS NOT NULL").select("system", F.slice("logits", F.lit(1), n).alias("scores"), (F.col("target") % n).cast("int").alias("target"))
    return H.candidate_loss(r, ["system"]).select("system", F.round("loss", 6).alias("loss"), "rows")
