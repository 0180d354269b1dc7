"""Checks of predictions on literal rows."""

import math

from pyspark.sql import functions as F

from millrace.operators import predictions as P


def test_publication_issues(spark):
    given = spark.createDataFrame([(1, "ok"), (1, "ok"), (2, None), (9, "bad"), (None, "ok")], "id int, status string")
    owed = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id int")
    count = lambda g, o: {r["code"]: r["n"] for r in P.publication_issues(g, o, "id", "status", ["ok"]).collect()}
    assert count(given, owed) == {"duplicate": 1, "illegal": 2, "missing": 1, "unknown": 2}
    assert set(count(given.limit(0), owed.limit(0)).values()) == {0}


def test_shape_error(spark):
    rows = [(None, 2, True), (None, 2, False), ([1.0], 2, True), ([1.0, math.inf], 2, True), ([1.0, None], 2, False), ([1.0, 2.0], 2, True)]
    got = spark.createDataFrame(rows, "z array<double>, n int, e boolean").select(P.shape_error(F.col("z"), F.col("n"), F.col("e")).alias("x"))
    assert [r["x"] for r in got.collect()] == ["absent", None, "width", "finite", "finite", None]


def test_label_probs(spark):
    rows = [
        ([("b", 0.0), ("a", math.log(3))],), ([("b", 0.0)],), ([("b", 0.0), ("a", 1.0), ("a", 2.0)],),
        ([("b", 0.0), ("a", 1.0), ("c", 2.0)],), ([("b", 0.0), ("a", math.nan)],),
    ]
    r = spark.createDataFrame(rows, "r array<struct<label: string, score: double>>")
    got = [x["x"] for x in r.select(P.label_probs(F.array(F.lit("a"), F.lit("b")), F.col("r")).alias("x")).collect()]
    assert [round(p, 9) for p in got[0]["probs"]] == [0.75, 0.25]
    assert [x["error"] for x in got] == [None, "missing", "duplicate", "unknown", "non-finite"]
    assert all(x["probs"] is None for x in got[1:])
