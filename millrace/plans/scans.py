"""Queries over sources and sinks: what is written is read again, by row, by place, by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import heads as H
from ..operators import scoring as C
from ..operators import validation as V
from ..operators.near import own_folder
from ..registry import Tables, query
from ..sources import io
from ..streaming import resume
from .sql import LOGITS, SEED, h

_ROW = "doc_id long, text string, lang string, source string, n_chars long"


@query("SELECT doc_id, sha256(text) AS text_hash, lang, source, n_chars, NULL::varchar AS broken FROM documents")
def jsonl_scan(t: Tables) -> DataFrame:
    """Documents as JSON lines and back; texts with quotes and newlines stay whole, and no line is broken."""
    path = own_folder(t.spark, "jsonl")
    io.write_jsonl(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), path)
    return io.read_jsonl(t.spark, path, _ROW).select("doc_id", F.sha2("text", 256).alias("text_hash"), "lang", "source", "n_chars", F.col("_corrupt_record").alias("broken"))


@query("""SELECT conv_id, turn, role, sha256(text) AS text_hash FROM conversations""")
def csv_scan(t: Tables) -> DataFrame:
    """Conversations as CSV with a header and back."""
    path = own_folder(t.spark, "csv")
    t.conversations.select("conv_id", "turn", "role", "text").write.option("header", True).option("escape", '"').csv(path)
    return io.read_csv(t.spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders) SELECT position, o_orderkey FROM p WHERE {h(f"'{SEED}:position:'||position", 8, 50)} = 0")
def positional_sample(t: Tables) -> DataFrame:
    """One in fifty places of a table that was written in order of its key, by hash of the place, and the rows that lie there."""
    path = own_folder(t.spark, "orders")
    t.orders.select("o_orderkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    table = t.spark.read.parquet(path)
    places = t.spark.range(table.count()).withColumnRenamed("id", "position").where(X.bucket(X.sha(SEED, "position", F.col("position")), 8, 50) == 0)
    return io.positional_sample(table, places).select("position", "o_orderkey")


@query("""WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, sum(n) OVER (ORDER BY conv_id) - n AS before FROM g) SELECT conv_id, turn FROM conversations JOIN b USING (conv_id) WHERE before < 150""")
def whole_trajectories(t: Tables) -> DataFrame:
    """Whole conversations in order until 150 turns are reached: the last one is not cut."""
    return io.first_whole(t.conversations.select("conv_id", "turn"), "conv_id", "conv_id", 150)


@query("SELECT lang, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY lang")
def required_rows(t: Tables) -> DataFrame:
    """A report over rows that must all be valid: the first one that is not fails the job."""
    good = V.require(t.documents, F.col("doc_id").isNull() | (F.col("n_chars") < 0), "a row without an id or with a negative size")
    return good.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id AS id, (n_chars % 97)::bigint AS score, (SELECT count(*) FROM documents) AS first_run, (SELECT count(*) FROM documents) AS second_run FROM documents")
def resumed_scores(t: Tables) -> DataFrame:
    """Documents scored as a stream that is started twice: the second start finds everything done, and scores nothing again."""
    source, out = own_folder(t.spark, "scored-source"), own_folder(t.spark, "scored")
    t.documents.select(F.col("doc_id").alias("id"), "n_chars").write.parquet(source)
    score = lambda d: d.select("id", (F.col("n_chars") % 97).alias("score"))
    counts = []
    for _ in range(2):
        resume.resume_scoring(t.spark, source, "id long, n_chars long", score, out, f"{out}-checkpoint").awaitTermination()
        counts.append(t.spark.read.parquet(out).count())
    return resume.progress(t.spark, out).select("id", "score", F.lit(counts[0]).cast("bigint").alias("first_run"), F.lit(counts[1]).cast("bigint").alias("second_run"))


@query(f"WITH {LOGITS} SELECT system, count(*) AS rows, true AS credit_same, true AS nll_same FROM (SELECT DISTINCT doc_id, system FROM z) GROUP BY system")
def order_invariance(t: Tables) -> DataFrame:
    """Scores of candidates in their order, and turned round, on other partitions: equal within 1e-5 for every row."""
    from .scores import logits

    r = logits(t).where("logits IS NOT NULL")
    turned = r.withColumn("logits", F.reverse("logits")).withColumn("target", F.col("n") - 1 - F.col("target")).repartition(7)
    one, two = C.scored(r).select("doc_id", "system", "credit", "nll"), C.scored(turned).select("doc_id", "system", F.col("credit").alias("c"), F.col("nll").alias("l"))
    both = one.join(two, ["doc_id", "system"])
    return both.groupBy("system").agg(F.count("*").alias("rows"), F.bool_and(F.abs(F.col("credit") - F.col("c")) < 1e-5).alias("credit_same"), F.bool_and(F.abs(F.col("nll") - F.col("l")) < 1e-5).alias("nll_same"))


def _projected(side: str, first: int) -> str:
    return f"[list_dot_product({side}, w{first}), list_dot_product({side}, w{first + 1}), list_dot_product({side}, w{first + 2})]"


@query(f"""WITH w AS (SELECT {", ".join(f"max(CASE WHEN vec_id = {k} THEN embedding::double[] END) AS w{k}" for k in range(6))} FROM embeddings),
p AS (SELECT x.vec_id, {_projected("x.embedding::double[]", 0)} AS s, {_projected("y.embedding::double[]", 3)} AS a FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1, w)
SELECT vec_id, round(list_cosine_similarity(s, a) / 0.07::double, 3) AS score FROM p""")
def projected_scores(t: Tables) -> DataFrame:
    """Each vector as a state with the next one as its action, through two heads whose rows are the table's first vectors."""
    import numpy as np
    import pyarrow as pa

    first = t.embeddings.where("vec_id < 6").select("vec_id", F.posexplode("embedding").alias("j", "value"))
    rows = first.select(F.when(F.col("vec_id") < 3, "state").otherwise("action").alias("name"), (F.col("vec_id") % 3).alias("i"), "j", "value")
    weights = H.head_weights(rows) | {"log_scale": np.array([[np.log(1 / 0.07)]])}
    pairs = t.embeddings.select("vec_id", F.col("embedding").alias("state")).join(t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("action")), "vec_id")
    sent = t.spark.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            if len(b):
                s, a = (np.stack([np.asarray(v.values, float) for v in b.column(k)]) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(H.projected_cosine(s, a, sent.value))], ["vec_id", "score"])

    return pairs.select("vec_id", "state", "action").mapInArrow(run, "vec_id long, score double").select("vec_id", F.round("score", 3).alias("score"))
