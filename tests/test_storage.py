"""Sinks, frozen recipes, the vector cache, scoring heads and the contrastive loss against plain forms."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.letters import letter_counts
from millrace.operators import embedding_cache, freeze, heads, vectors
from millrace.operators.near import shared_folder
from millrace.sources import csr


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def local(folder):
    return folder.removeprefix("file:")


def token_rows(n):
    rnd = random.Random(n)
    return [(k * 7 - 50, [rnd.randrange(1 << 31) for _ in range(rnd.choice([0, 1, 5, 300]))]) for k in range(n)]


def test_csr_round_trip(spark, folder, monkeypatch):
    rows = token_rows(200)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "id long, tokens array<int>").repartition(5)
    csr.write_csr(df, folder)
    got = sorted(csr.read_csr(spark, folder).collect())
    assert [(r.id, r.tokens) for r in got] == rows
    assert [r.start for r in got] == [sum(len(t) for _, t in rows[:k]) for k in range(len(rows))]
    sizes = {k: sum(os.path.getsize(f"{local(folder)}/{f}") for f in os.listdir(local(folder)) if f.endswith(k)) for k in (".tokens", ".offsets", ".ids")}
    assert sizes == {".tokens": 4 * sum(len(t) for _, t in rows), ".offsets": 8 * 200, ".ids": 8 * 200}


def test_csr_refuses_a_second_commit(spark, folder):
    df = spark.createDataFrame(token_rows(3), "id long, tokens array<int>")
    csr.write_csr(df, folder)
    before = sorted(os.listdir(local(folder)))
    with pytest.raises(Exception, match="written before"):
        csr.write_csr(df, folder)
    late = csr.CsrWriter(folder)  # a job that began before the other one committed
    for kind in ("tokens", "offsets", "ids"):
        open(f"{local(folder)}/late.{kind}", "w").close()
    with pytest.raises(ValueError, match="written before"):
        late.commit([csr.Part("late", 0, 0), None])
    assert sorted(os.listdir(local(folder))) == before


@pytest.mark.parametrize("bad", [(1, None), (None, [1]), (1, [None]), (1, [-1])])
def test_csr_failed_task_leaves_nothing(spark, folder, bad):
    df = spark.createDataFrame([*token_rows(20), bad], "id long, tokens array<int>").repartition(4)
    with pytest.raises(Exception):
        csr.write_csr(df, folder)
    assert not os.path.exists(f"{local(folder)}/{csr.MANIFEST}") and not [f for f in os.listdir(local(folder)) if not f.startswith(".")]
    with pytest.raises(Exception):
        csr.read_csr(spark, folder).count()


def test_csr_empty(spark, folder):
    csr.write_csr(spark.createDataFrame([], "id long, tokens array<int>"), folder)
    assert csr.read_csr(spark, folder).count() == 0


def test_frozen_recipe(spark, folder):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.range(5)
    tables, limits = {"train": a, "final": b}, {"state": 2048}
    with pytest.raises(ValueError, match="rationale"):
        freeze.freeze(spark, folder, tables, limits, " ")
    with pytest.raises(ValueError, match="no recipe"):
        freeze.validate(spark, folder, tables, limits)
    assert freeze.freeze(spark, folder, tables, limits, "best on development") == "frozen"
    assert freeze.freeze(spark, folder, {"train": a.orderBy(F.desc("k")), "final": b.repartition(3)}, limits, "best on development") == "reused"
    changed = spark.createDataFrame([(1, "x"), (2, "")], "k int, v string")
    for what, t, lim in (("table train", {**tables, "train": changed}, limits), ("limit state", tables, {"state": 4096}), ("table final", {**tables, "final": b.limit(4)}, limits), ("table more", {**tables, "more": b}, limits)):
        with pytest.raises(ValueError, match=what):
            freeze.freeze(spark, folder, t, lim, "best on development")
        with pytest.raises(ValueError, match=what):
            freeze.open_final(spark, folder, t, lim)
    assert freeze.open_final(spark, folder, tables, limits).count() == 4
    assert freeze.open_final(spark, folder, tables, limits).count() == 4
    with pytest.raises(ValueError, match="opened"):
        freeze.freeze(spark, folder, tables, limits, "best on development")


def test_cache_encodes_once(spark, folder):
    rows = [(k, "ab" * (k % 17)) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    assert embedding_cache.encode_missing(df, folder, letter_counts, wave=5, padded=60, most=3) == 17
    assert embedding_cache.encode_missing(df, folder, letter_counts) == 0
    got = {r.id: r.vector for r in embedding_cache.embedded(df, folder).collect()}
    assert got[60] is None and all(got[k] == [len(t), t.count("a"), 0, 0] for k, t in rows[:60])


def test_cache_resumes_after_a_lost_run(spark, folder):
    """The third wave fails: what the first two encoded stays, and the next run encodes only the rest."""
    df = spark.createDataFrame([(k, "x" * (k + 1)) for k in range(20)], "id long, text string")

    def fails(texts):
        if max(map(len, texts)) > 12:
            raise RuntimeError("lost")
        return letter_counts(texts)

    with pytest.raises(Exception, match="lost"):
        embedding_cache.encode_missing(df, folder, fails, wave=5)
    kept = embedding_cache.cached(spark, folder).count()
    assert kept == 10
    assert embedding_cache.encode_missing(df, folder, letter_counts, wave=5) == 10 and embedding_cache.cached(spark, folder).count() == 20


def test_cache_batches(spark, folder):
    """Texts come in order of length, and no batch passes its padded size unless it is one text."""
    df = spark.createDataFrame([(k, "y" * n) for k, n in enumerate([1, 2, 3, 50, 51, 52, 200, 4, 5, 6])], "id long, text string").coalesce(1)

    def checked(texts):
        sizes = list(map(len, texts))
        if sizes != sorted(sizes) or len(sizes) > 4 or len(sizes) > 1 and len(sizes) * max(sizes) > 110:
            raise RuntimeError(f"bad batch {sizes}")
        return letter_counts(texts)

    assert embedding_cache.encode_missing(df, folder, checked, padded=110, most=4) == 10


WEIGHTS = {"gain": [[1.0, 2, 0.5, 1]], "bias": [[0.1, 0, 0, -0.2]], "w1": [[1, -1, 0.5, 0], [0.2, 0.3, 1, -1], [0, 0, 1, 1]], "b1": [[0.1, -0.1, 0]], "w2": [[1.0, -2, 0.3]], "b2": [[0.05]]}


def weight_rows(w):
    return [(name, i, j, float(x)) for name, m in w.items() for i, row in enumerate(m) for j, x in enumerate(row)]


def test_head_weights(spark):
    rows = weight_rows(WEIGHTS)
    got = heads.head_weights(spark.createDataFrame(rows, "name string, i int, j int, value double"))
    assert all(np.array_equal(got[k], np.array(v, float)) for k, v in WEIGHTS.items())
    for bad in (rows[1:], [*rows, ("w9", 0, 0, float("nan"))], [*rows, rows[0]]):
        with pytest.raises(ValueError):
            heads.head_weights(spark.createDataFrame(bad, "name string, i int, j int, value double"))
    with pytest.raises(ValueError, match="more than 3"):
        heads.head_weights(spark.createDataFrame(rows, "name string, i int, j int, value double"), most=3)


def test_scalar_head_by_hand():
    from math import erf, sqrt

    w = {k: np.array(v, float) for k, v in WEIGHTS.items()}
    x = [3.0, -1, 0, 2]
    mean = sum(x) / 4
    var = sum((v - mean) ** 2 for v in x) / 4
    z = [(v - mean) / sqrt(var + 1e-5) * g + b for v, g, b in zip(x, w["gain"][0], w["bias"][0])]
    h = [sum(a * b for a, b in zip(row, z)) + c for row, c in zip(w["w1"], w["b1"][0])]
    h = [v / 2 * (1 + erf(v / sqrt(2))) for v in h]
    assert heads.scalar_head(np.array([x]), w)[0] == pytest.approx(sum(a * b for a, b in zip(w["w2"][0], h)) + 0.05)


def test_projected_cosine_is_clamped():
    rng = np.random.default_rng(1)
    s, a, p = rng.normal(size=(4, 6)), rng.normal(size=(4, 6)), rng.normal(size=(3, 6))
    w = {"state": p, "action": p, "log_scale": np.array([[np.log(1 / 0.07)]])}
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (u(u(s) @ p.T) * u(u(a) @ p.T)).sum(1)
    assert np.allclose(heads.projected_cosine(s, a, w), want / 0.07)
    assert np.allclose(heads.projected_cosine(s, a, w | {"log_scale": np.array([[9.0]])}), want * 100)


def test_joint_ranking(spark):
    """Requests that break a rule have a reason and no score, whatever their other candidates; equal scores keep their order."""
    c = lambda *t: [(str(k), x) for k, x in enumerate(t)]
    rows = [(1, "a state", c("aa", "e e", "aa e", "e e x")), (2, "s", c("one")), (3, "s", c("a", " ")), (4, "s", c("a", "a")), (5, " ", c("a", "b")), (6, "one two three four five", c("a", "b")), (7, "s", c("a", "one two three four")), (8, "one two three", c("x", "one two three")), (9, "s", c(*map(str, range(65)))), (10, "s", None), (11, "s", c("ab", "ba"))]
    df = spark.createDataFrame(rows, "id long, state string, candidates array<struct<key:string,text:string>>")
    words = lambda x: F.size(F.split(F.trim(x), "\\s+"))
    error = heads.request_error(F.col("state"), F.transform("candidates", lambda x: x["text"]), words, 4, 3, 7)
    w = {k: np.array(v, float) for k, v in WEIGHTS.items()}
    got = {}
    for r in heads.rank_joint(df, letter_counts, w, error, rows=3).collect():
        got.setdefault(r.id, []).append(r)
    reasons = {2: "too few candidates", 3: "empty candidate", 4: "repeated candidate", 5: "empty state", 6: "long state", 7: "long candidate", 8: "long joint input", 9: "too many candidates", 10: "too few candidates"}
    assert {k: v[0].reason for k, v in got.items() if v[0].reason} == reasons and all(len(got[k]) == 1 and got[k][0].score is None for k in reasons)
    scores = heads.scalar_head(letter_counts(["a state" + heads.SEPARATOR + t for _, t in rows[0][2]]), w)
    order = sorted(range(4), key=lambda k: (-scores[k], k))
    assert [(r.place, r.key) for r in sorted(got[1], key=lambda r: r.rank)] == [(k, str(k)) for k in order]
    assert [r.score for r in sorted(got[1], key=lambda r: r.place)] == pytest.approx(list(scores))
    assert [r.place for r in sorted(got[11], key=lambda r: r.rank)] == [0, 1]


def test_candidate_loss(spark):
    rows = [("g", [1.0, 2.0, None, 0.5], 1), ("g", [3.0], 0), ("g", None, 0), ("g", [1.0, 2.0], 5), ("h", [1000.0, 1001.0, 999.0], 2)]
    got = {r.g: (r.loss, r.rows) for r in heads.candidate_loss(spark.createDataFrame(rows, "g string, scores array<double>, target int"), ["g"]).collect()}
    one = np.log(np.exp([1.0, 2.0, 0.5]).sum()) - 2.0
    assert got["g"] == (pytest.approx(one / 2), 2) and got["h"] == (pytest.approx(2 + np.log(1 + np.exp(-1) + np.exp(-2))), 1)


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_contrastive_loss(spark, block):
    """Equal to the plain loss over the whole matrix of a batch, whatever its blocks; null keys and groups equal nothing."""
    rng, rnd = np.random.default_rng(2), random.Random(2)
    rows = [(b, k, rng.normal(size=5).tolist(), rng.normal(size=5).tolist(), rnd.choice([None, "s", "t", str(k)]), rnd.choice([None, 1, 2, 3, k + 10]), rnd.choice([None, "g", "h"])) for b, n in ((0, 23), (1, 1), (2, 8)) for k in range(n)]
    df = spark.createDataFrame([*rows, (2, 99, None, [1.0] * 5, "s", 1, "g")], "batch long, id long, state array<double>, action array<double>, state_key string, action_key int, group string")
    got = {r.batch: (r.loss, r.rows) for r in vectors.contrastive_loss(df, "batch", scale=5.0, block=block).collect()}
    for b in (0, 1, 2):
        x = [r for r in rows if r[0] == b]
        unit = lambda m: np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
        z = unit([r[2] for r in x]) @ unit([r[3] for r in x]).T * 5.0
        same = lambda k: np.array([[p[k] is not None and p[k] == q[k] for q in x] for p in x])
        positive = same(4) | same(5) | np.eye(len(x), dtype=bool)
        counted = positive | ~same(6)
        lse = lambda m, axis: np.log(np.where(m, np.exp(z), 0).sum(axis))
        want = np.mean([np.mean(lse(counted, axis) - lse(positive, axis)) for axis in (0, 1)])
        assert got[b] == (pytest.approx(want), len(x))


def test_best_of_a_block_in_bounded_memory():
    """Ties by id, rows without a direction, fewer rows than k; of 2000 x 2000 cosines only those of some queries are held."""
    import tracemalloc

    rnd = np.random.default_rng(5)
    for n, m, k in ((300, 400, 5), (7, 3, 5), (1, 1, 2)):
        x, y = rnd.integers(-1, 2, (n, 3)).astype(float), rnd.integers(-1, 2, (m, 3)).astype(float)
        a, b = rnd.permutation(1000)[:n], rnd.permutation(1000)[:m]
        want = []
        with np.errstate(all="ignore"):
            for i, u in zip(a, x):
                c = [(-round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 6), int(j)) for j, v in zip(b, y) if i != j and u.any() and v.any()]
                want += [(int(i), j, -s) for s, j in sorted(c)[:k]]
        got = [r for part in vectors._best(a, x, b, y, k) for r in zip(*(c.tolist() for c in part))]
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    x = rnd.normal(size=(2000, 64))
    tracemalloc.start()
    assert sum(len(part[0]) for part in vectors._best(np.arange(2000), x, np.arange(2000), x, 5)) == 10000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
