"""Operators 4 and 7 against plain numpy: forward pass, gradient, windows, normal equations, isotonic steps, scores of whole queries."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, quality


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["The", "end", "of", "99", "ééé", "lines.", "UP", "!!", "a", "long-word-" * 3]
    return [" ".join(rnd.choice(words) + rnd.choice(["", "\n"]) for _ in range(rnd.choice([0, 1, 7, 60, 400]))) for _ in range(n)]


def packed(rows):
    raw = [t.encode() for t in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def small_net():
    net = language.ByteCnn(["x", "y", "z"], filters=3, size=2)
    rng = np.random.default_rng(4)
    net.p["out"] = rng.normal(size=net.p["out"].shape)
    net.p["bias"] = rng.normal(size=3)
    for w in language.WIDTHS:
        net.p[f"b{w}"] = rng.normal(size=3)
    return net


def plain_forward(net, window):
    """One window: every filter at every place, the maximum, softmax."""
    pooled = []
    for w in language.WIDTHS:
        for f in range(net.p[f"conv{w}"].shape[1]):
            places = [sum(net.p["emb"][window[p + k]] @ net.p[f"conv{w}"][2 * k : 2 * k + 2, f] for k in range(w)) for p in range(len(window) - w + 1)]
            pooled.append(max(0.0, max(places) + net.p[f"b{w}"][f]))
    z = np.array(pooled) @ net.p["out"] + net.p["bias"]
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_forward_and_text_scores():
    net = small_net()
    rows = ["", "short", "é" * 100, "words of a longer text, " * 40]
    data, offsets = packed(rows)
    got = net.score_texts(data, offsets, net.tables())
    step = language.WINDOW - max(language.WIDTHS) + 1
    for k, t in enumerate(rows):
        b = t.encode()
        n = max(1, -(-max(len(b) - (max(language.WIDTHS) - 1), 1) // step))
        windows = [b[max(0, min(i * step, len(b) - language.WINDOW)) :][: language.WINDOW] for i in range(n)]
        covered = set().union(*(range(max(0, min(i * step, len(b) - language.WINDOW)), min(len(b), max(0, min(i * step, len(b) - language.WINDOW)) + language.WINDOW)) for i in range(n)))
        assert covered == set(range(len(b)))  # every byte is in a window
        want = np.mean([np.log(plain_forward(net, list(w.ljust(language.WINDOW))) + 1e-9) for w in windows], axis=0)
        assert np.allclose(got[k], want, atol=1e-4)
    x = np.array([list(b"some window of bytes".ljust(language.WINDOW))])
    assert np.allclose(net.forward(x)[0][0], plain_forward(net, x[0]), atol=1e-5)


def test_gradient_is_that_of_the_loss():
    net = small_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 123, (5, language.WINDOW)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(5), y]).mean()
    g = net.gradient(x, y)
    for name, at in (("out", (1, 2)), ("bias", (0,)), (f"conv{language.WIDTHS[0]}", (1, 1)), (f"b{language.WIDTHS[-1]}", (2,)), ("emb", (int(x[0, 3]), 1))):
        value = net.p[name][at]
        net.p[name][at] = value + 1e-6
        up = loss()
        net.p[name][at] = value - 1e-6
        assert g[name][at] == pytest.approx((up - loss()) / 2e-6, abs=1e-5)
        net.p[name][at] = value


def test_isotonic():
    rng = np.random.default_rng(3)
    x, y, w = np.sort(rng.normal(size=60)), rng.random(60), rng.integers(1, 9, 60).astype(float)
    at, value = quality.isotonic(x, y, w)
    # the least-squares non-decreasing fit is, at each place, the largest of the least means over intervals around it
    mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    steps = sorted(set(np.round(want, 9)))
    assert np.allclose(value, steps) and (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_fit_is_the_ridge_solution(spark):
    """Weights and steps from Spark's partition sums equal those from one matrix."""
    rows = texts(5, 300)
    x = quality.statistics(*packed(rows))
    rnd = random.Random(6)
    y = np.array([float(len(t) > 100) if rnd.random() < 0.9 else 1.0 - float(len(t) > 100) for t in rows])
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "stats array<double>, label int").repartition(5)
    model = quality.fit(df)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-6)))
    f = model.features(x)
    solve = lambda a, b: np.linalg.solve(a.T @ a / len(a) + quality.RIDGE * np.eye(f.shape[1]), a.T @ b / len(a))
    assert np.allclose(model.weights, solve(f, y), atol=1e-6)
    of = quality.folds(x)
    raw = np.array([np.clip(f[k] @ solve(f[of != of[k]], y[of != of[k]]), -0.5, 1.5) for k in range(len(x))])
    at = ((raw + 0.5) / 2 * (quality.BINS - 1)).astype(int)
    bins = sorted(set(at))
    pick = lambda v: np.array([v[at == b].mean() for b in bins])
    want = quality.isotonic(pick(raw), pick(y), np.array([float((at == b).sum()) for b in bins]))
    assert np.allclose(model.at, want[0], atol=1e-6) and np.allclose(model.value, want[1], atol=1e-6)


def test_quality_query_by_hand(spark):
    """Scores of every document, long and empty ones too, from a model that is fitted outside Spark on the rows that may be learned from."""
    rows = [(k, t) for k, t in enumerate(texts(8, 200))] + [(200, None), (201, ""), (202, "A text. " * 20_000), (None, "no id")]
    labels = [(k, int(len(t or "") > 100), 0) for k, t in rows[:150]]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2 for k, _ in rows}
    learned = [(k, y) for k, y, _ in labels if not held[k]]
    by_id = dict(rows)
    x = quality.statistics(*packed([by_id[k] or "" for k, _ in learned]))
    model = quality.fit(spark.createDataFrame([(r.tolist(), y) for r, (_, y) in zip(x, learned)], "stats array<double>, label int"))
    for k, t in rows:
        score = model.score(quality.statistics(*packed([t or ""])))[0]
        assert got[k].held_out == held[k] and got[k].score == pytest.approx(score, abs=1e-6) and got[k].predicted == int(got[k].score >= 0.7)


def test_language_query_by_hand(spark):
    """lang_pred and score of every document from the model's own windows; very long and letterless texts."""
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice("abcd " if k % 2 else "wxyz ") for _ in range(rnd.choice([30, 300, 3000]))), "one" if k % 2 else "two") for k in range(60)]
    df = spark.createDataFrame([*rows, (60, "ab cd " * 30_000, None), (61, "12 ...", None), (62, None, None), (None, "wx yz", "two")], "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1"))
    tables = model.tables()
    for r in language.language_id(df).join(df.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = language.softmax(model.score_texts(*packed([r.text]), tables))[0]
        assert r.lang_pred == model.classes[p.argmax()] and r.score == pytest.approx(p.max(), abs=1e-5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
