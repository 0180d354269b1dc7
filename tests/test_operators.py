"""Operators that SQL does not express, on literal fixtures."""

import gzip
import json
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import greedy as G
from millrace.operators import near as N
from millrace.operators import sampling as Q
from millrace.operators import scoring as C
from millrace.operators import splits as S
from millrace.operators import validation as V
from millrace.sources import io
from millrace.streaming import resume


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [("ﬁne Straße", "fine strasse"), ("ＡＢ\u00a0c", "ab c"), ("a\t\n b", "a b"), ("", ""), ("İ", "i̇"), (None, None)])
def test_norm_full(spark, text, want):
    assert one(spark, X.norm_full, text) == want


def test_prose_and_json(spark):
    assert one(spark, X.prose, '{"a": {"b": [1, true, null]}, "c": "x"}') == "a:\n  b:\n    - 1\n    - true\n    -\n\nc: x".replace("-\n\nc", "- \n\nc")
    assert one(spark, X.prose, "plain") == "plain"
    assert one(spark, X.canonical_json, '{"b": 1, "a": "é"}') == '{"a":"\\u00e9","b":1}'
    assert one(spark, X.strict_json, '{"a": 1, "a": 2}') is False
    assert one(spark, X.strict_json, '{"a": NaN}') is False
    assert one(spark, X.strict_json, '{"a": 1}') is True


def test_scores(spark):
    def score(logits, target=None, probs=None):
        df = spark.createDataFrame([(logits, target, probs, 3)], "logits array<double>, target int, target_probs array<double>, n int")
        return C.scored(df).first()

    tie = score([1.0, 1.0, 0.0], 0)
    assert tie["credit"] == 0.5
    assert score([1.0, 1.0 - 5e-8, 0.0], 1)["credit"] == 0.0  # ties are exact here
    soft = score([0.0, 0.0, 0.0], None, [0.5, 0.5, 0.0])
    assert soft["nll"] == pytest.approx(math.log(3)) and soft["credit"] == pytest.approx(1 / 3)
    missing = score(None, 0)
    assert missing["credit"] == 0.0 and missing["nll"] is None
    near = spark.createDataFrame([([1.0, 1.0 - 5e-8, 0.0], [0.0, 1.0, 0.0])], "z array<double>, t array<double>")
    assert near.select(C.credit(F.col("z"), F.col("t"), 1e-7).alias("c")).first()["c"] == 0.5


def test_sketch_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, "a b"), (3, "a b c d e f")], "id long, text string")
    got = {r["id"]: len(r["sketch"]) for r in N.sketches(df, "id", F.col("text")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_components_and_closure(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a long, b long")
    ids = spark.range(1, 50)
    got = {r["id"]: r["component"] for r in N.components(pairs, ids).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[k] == k for k in range(41, 50))
    # b falls with a's text, c with b's; d owns a text that a also owned, so that one stays allowed
    owners = spark.createDataFrame([("a", "t1"), ("a", "g"), ("d", "g"), ("b", "t2"), ("c", "t3")], "group string, text string")
    contains = spark.createDataFrame([("b", "t1"), ("c", "t2"), ("e", "g")], "group string, text string")
    removed = spark.createDataFrame([("a",)], "group string")
    assert {r["group"] for r in N.closure(owners, contains, removed).collect()} == {"a", "b", "c"}


def test_bucket_policy(spark):
    same = spark.createDataFrame([(k, ["a", "b"]) for k in range(4)], "id long, sketch array<string>")
    assert N.near_pairs(same, same, 0.85, True).count() == 6
    assert N.near_pairs(same, same, 0.85, True, most=4).count() == 6
    assert N.near_pairs(same, same, 0.85, True, most=3).count() == 0


def test_greedy_blocked_row_frees_its_group(spark):
    """A row that is barred by a near one leaves its group to a later row."""
    rows = spark.createDataFrame([(0, "final", "l", ["g:1"], 7, True), (1, "train", "l", ["g:2"], 8, False), (2, "train", "m", ["g:2"], 9, False), (3, "train", "m", ["g:3"], 9, False)], "place long, cell string, label string, keys array<string>, class long, blocks boolean")
    got = G.greedy(rows, spark.createDataFrame([(7, 8)], "a long, b long"), 5, 1)
    assert sorted(r.place for r in got.collect()) == [0, 2]


def test_distinct_group_batches(spark):
    rows = spark.createDataFrame([(0, k, "a" if k < 3 else "b") for k in range(5)], "chunk long, n long, grp string")
    got = G.distinct_group_batches(rows, "chunk", "n", "grp", 2).collect()
    for batch in {r["batch"] for r in got}:
        groups = [r["grp"] for r in got if r["batch"] == batch]
        assert len(groups) == len(set(groups))
    assert len(got) == 5


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("g"))
    split = lambda d: {r["g"]: r["s"] for r in d.select("g", S.grouped(F.col("g"), "s").alias("s")).collect()}
    assert split(df) == split(df.repartition(7))
    assert len(set(split(df).values())) == 4


def test_quota_and_checks(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(30)], "id long, c long")
    assert Q.quota(df, ["c"], [F.col("id")], 4).count() == 12
    with pytest.raises(Exception, match="bad row"):
        V.require(df, F.col("id") == 7, "bad row").collect()


def test_jsonl_csv_and_sinks(spark, tmp_path):
    rows = [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    got = io.read_jsonl(spark, str(tmp_path / "x.jsonl.gz"), "id string, n int").collect()
    assert [r["id"] for r in got] == ["a", "b", None] and got[2]["_corrupt_record"] == "{broken"
    (tmp_path / "x.csv").write_text('text,category\n"a ""q"", b\nc",k\n')
    assert io.read_csv(spark, str(tmp_path / "x.csv"), "text string, category string").first()["text"] == 'a "q", b\nc'
    (tmp_path / "x.json").write_text(json.dumps(rows))
    assert io.read_json_array(spark, str(tmp_path / "x.json"), "id string, n int").count() == 2
    df = spark.createDataFrame(rows, "id string, n int")
    io.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        io.write_jsonl(df, str(tmp_path / "out"))
    io.write_report({"a": 1}, str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        io.write_report({"a": float("nan")}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        io.write_new("x", str(tmp_path / "r.json"))
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    picked = io.positional_sample(spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame([(1,)], "position long"))
    assert [r["id"] for r in picked.collect()] == ["b"]
    assert io.first_whole(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "g string, o long"), "g", "o", 3).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"abc")
    assert io.file_hashes(spark, str(tmp_path / "d")).first()["sha256"] == io.file_hash(str(tmp_path / "d" / "a"))
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        t.add(tmp_path / "d" / "a", "a")
    assert io.tar_members(str(tmp_path / "t.tar"), ["a"]) == {"a": b"abc"}
    with pytest.raises(ValueError):
        io.contained(str(tmp_path), "../x")
    assert io.frozen_write(spark.range(1), str(tmp_path / "f"), "h", "h") is False
    with pytest.raises(ValueError):
        io.frozen_write(spark.range(1), str(tmp_path / "f"), "h", "other")


def test_resume(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    spark.range(3).write.parquet(src)
    score = lambda df: df.withColumn("score", F.col("id") * 2)
    resume.resume_scoring(spark, src, "id long", score, out, at).awaitTermination()
    spark.range(3, 5).write.mode("append").parquet(src)
    resume.resume_scoring(spark, src, "id long", score, out, at).awaitTermination()
    assert sorted(r["id"] for r in resume.progress(spark, out).collect()) == [0, 1, 2, 3, 4]
