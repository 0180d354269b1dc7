"""Small rules against literal rows, and percentiles and places of files against plain lists."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import preparation as P
from millrace.operators import ranking, ranks, scoring, validation
from millrace.operators.near import shared_folder
from millrace.sources import io


def column(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("x, want", [("a b c", ("a b", "c")), ("abc", ("abc", None)), ("a ", ("a", "")), (" a", ("", "a")), ("", ("", None))])
def test_right_split(spark, x, want):
    assert tuple(column(spark, x, "string", lambda c: X.right_split(c, " "))) == want


def test_prefix_and_render(spark):
    assert column(spark, "Brand#12", "string", lambda c: X.strip_prefix(c, "Brand#")) == "12" and column(spark, "rand#12", "string", lambda c: X.strip_prefix(c, "Brand#")) == "rand#12"
    assert column(spark, " s \n", "string", lambda c: X.legacy_render(c, F.lit(" q "))) == "s\n\nq"
    assert column(spark, " s \n", "string", lambda c: X.legacy_render(c, F.lit(None))) == "s" and column(spark, None, "string", lambda c: X.legacy_render(c, F.lit("q"))) == "q"


def test_action_text(spark):
    args = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    of = lambda kind: column(spark, kind, "string", lambda c: X.action_text(c, F.lit("f"), args, F.lit("py"), F.lit("x = 1")))
    assert [of(k) for k in ("api", "code", "say", None)] == ["f(a=1, b=2)", "py:\nx = 1", "x = 1", "x = 1"]


def test_pair_issue(spark):
    rows = [("A  b", "a b"), (" ", "x"), (None, "x"), ("a", None), ("a", "b")]
    got = spark.createDataFrame(rows, "p string, n string").select(P.pair_issue(F.col("p"), F.col("n"), X.norm).alias("i")).collect()
    assert [r.i for r in got] == ["same", "blank", "blank", None, None]


def test_fits(spark):
    tokens = lambda c: F.size(F.split(c, " "))
    rows = [("a b", ["c", "d e"]), ("a b c d", ["c"]), ("a b", ["c d e f"]), ("a b c", ["d e f"]), ("a" * 30, ["c"]), ("a", []), ("a", None), (None, ["c"]), ("a", ["c" * 20])]
    got = spark.createDataFrame(rows, "s string, c array<string>").select(P.fits(F.col("s"), F.col("c"), tokens, " ", (30, 20), (3, 3, 5)).alias("f")).collect()
    assert [r.f for r in got] == [True, False, False, False, False, False, False, False, False]


def test_row_errors(spark):
    norm = lambda x: F.lower(F.trim(x))
    rows = [("s", "train", ["a", "b"], 0, None), (" ", "x", ["a", "b"], 2, None), ("s", "train", ["a", "A "], 7, [2.0]), ("s", "train", None, None, None), ("s", "train", ["a", " "], None, None), ("s", "train", ["a", "b"], None, None), ("s", "train", ["a", "b"], None, [1.2, -0.2]), ("s", "train", ["a", "b"], None, [0.5, float("nan")]), ("s", "train", ["a", "b"], 0, [0.5, 0.4, 0.2]), ("s", "train", [str(k) for k in range(65)], 0, None)]
    c = F.col
    got = spark.createDataFrame(rows, "s string, split string, c array<string>, t int, p array<double>").select(validation.row_errors({"state": c("s")}, c("split"), ["train"], F.lit("m"), ["m"], c("c"), norm, c("t"), c("p")).alias("e")).collect()
    assert [r.e for r in got] == [
        [], ["missing_state", "target_out_of_range", "unknown_split"], ["candidates_repeated"], ["candidates_missing"], ["candidate_blank"], ["supervision_missing"], ["probs_negative"], ["probs_not_finite", "probs_wrong_sum"], ["probs_wrong_length", "probs_wrong_sum"], ["candidates_too_many"],
    ]


def test_built(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, kind string")
    got = P.built(df, ["id"], {"kind": "plain", "version": 3}, {"kind": F.col("kind")}).collect()
    assert [tuple(r) for r in got] == [(1, "x", 3), (2, "plain", 3)]


def test_target_error(spark):
    rows = [([0.5, 0.5],), ([0.5, 0.4],), ([1.5, -0.5],), ([1.0],), ([float("inf"), 0.0],), (None,), ([0.5, None],)]
    got = spark.createDataFrame(rows, "p array<double>").select(scoring.target_error(F.col("p"), F.lit(2)).alias("e")).collect()
    assert [r.e for r in got] == [None, "sum", "negative", "length", "not finite", None, "not finite"]


def test_served(spark):
    z = [0.0, 1.0, 3.0]
    p = np.exp(np.array(z) / 2) / np.exp(np.array(z) / 2).sum()
    of = lambda kind: column(spark, z, "array<double>", lambda c: ranking.served(F.lit(kind), F.array(*map(F.lit, "abc")), c, F.lit(1), 2.0))
    assert of("choice").choice == "c" and of("choice").value is None and of("choice").probabilities == pytest.approx(p)
    assert of("score").value == pytest.approx(p @ [0, 1, 2]) and of("score").choice is None
    assert of("noul").value == pytest.approx(p[1]) and of("noul").probabilities is None


def test_question_pairs(spark):
    q = [("a", "choice", " What? ", [("k", " "), ("l", "Text")]), ("b", "noul", None, None), ("c", "score", "How?", [("x", "low"), ("y", "high")])]
    df = spark.createDataFrame([(1, " state ", q), (2, None, q[1:2])], "id long, state string, questions array<struct<qid:string,kind:string,instructions:string,criteria:array<struct<key:string,text:string>>>>")
    got = {(r.id, r.qid, r.place): (r.state_text, r.key, r.text) for r in ranking.pairs(df, "id").collect()}
    assert got == {
        (1, "a", 0): ("state\n\nWhat?", "k", "k"), (1, "a", 1): ("state\n\nWhat?", "l", "Text"), (1, "b", 0): ("state", "false", "No, this is false."), (1, "b", 1): ("state", "true", "Yes, this is true."),
        (1, "c", 0): ("state\n\nHow?", "0", "low"), (1, "c", 1): ("state\n\nHow?", "1", "high"), (2, "b", 0): ("", "false", "No, this is false."), (2, "b", 1): ("", "true", "Yes, this is true."),
    }


def test_percentiles(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.0, rnd.random() * 9])) for _ in range(200)] + [("one", 5.0), ("none", None)]
    points = {"low": 0.0, "p31": 0.31, "half": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", points).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        v = [x for k, x in rows if k == g and x is not None]
        assert r.n == len(v) and all(r[k] == pytest.approx(np.quantile(v, p)) for k, p in points.items())


def test_positional_sample_over_files(spark):
    path = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    got = io.positional_sample(spark.read.parquet(path), spark.createDataFrame([(0,), (499,), (999,), (5000,)], "position long")).collect()
    assert sorted((r.position, r.id) for r in got) == [(0, 0), (499, 499), (999, 999)]


def test_first_whole(spark):
    rows = [(g, k) for k, g in enumerate("bbbacccccd")]
    got = io.first_whole(spark.createDataFrame(rows, "g string, o long"), "g", "o", 4).collect()
    assert sorted({r.g for r in got}) == ["a", "b"] and len(got) == 4
    assert io.first_whole(spark.createDataFrame(rows, "g string, o long"), "g", "o", 5).count() == 9


def test_capped_report_counts_null_kinds(spark):
    rows = [("x", k) for k in range(5)] + [(None, 9)]
    got = validation.capped_report(spark.createDataFrame(rows, "kind string, id int"), "kind", [F.col("id")], 2).collect()
    assert sorted((r.kind or "", r.id, r.total) for r in got) == [("", 9, 1), ("x", 0, 5), ("x", 1, 5)]
