"""Operator 4: language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Bytes of a window; two windows overlap by the widest filter less one byte, so that no filter position is lost.
WINDOW = 256
WIDTHS = (2, 3, 4)


class ByteCnn:
    """Byte embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, classes: list[str], filters: int = 16, size: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": r.normal(0, 0.5, (256, size)).astype(np.float32), "out": np.zeros((filters * len(WIDTHS), len(classes)), np.float32), "bias": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = r.normal(0, (1 / (w * size)) ** 0.5, (w * size, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: windows of WINDOW bytes. Probabilities, and what the gradient needs."""
        e = self.p["emb"][x]
        pooled, keep = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols = np.concatenate([e[:, k : k + n] for k in range(w)], axis=2)
            z = cols @ self.p[f"conv{w}"]
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
            keep.append((cols, at))
        h = np.maximum(np.concatenate(pooled, 1), 0)
        return softmax(h @ self.p["out"] + self.p["bias"]), [h, keep]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> "ByteCnn":
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            for idx in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                t += 1
                g = self.gradient(x[idx], y[idx])
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= rate * (0.5 ** (epoch // 2)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, (h, keep) = self.forward(x)
        d = prob
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(self.p["emb"])}
        dh = (d @ self.p["out"].T) * (h > 0)
        f = dh.shape[1] // len(WIDTHS)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            cols, at = keep[k]
            part = dh[:, k * f : (k + 1) * f]
            top = cols[rows, at]  # windows x filters x taps
            g[f"conv{w}"] = np.einsum("bft,bf->tf", top, part)
            g[f"b{w}"] = part.sum(0)
            back = np.einsum("tf,bf->bft", self.p[f"conv{w}"], part).reshape(*at.shape, w, -1)
            np.add.at(g["emb"], x[rows[:, :, None], at[:, :, None] + np.arange(w)], back)
        return g

    def tables(self) -> dict[str, np.ndarray]:
        """For scoring: what each byte, and each pair of neighbouring bytes, adds to each filter at each tap."""
        size, out = self.p["emb"].shape[1], {}
        for w in WIDTHS:
            taps = [self.p["emb"] @ self.p[f"conv{w}"][k * size : (k + 1) * size] for k in range(w)]
            for k in range(0, w - 1, 2):
                out[f"{w}:{k}"] = (taps[k][:, None] + taps[k + 1][None, :]).reshape(1 << 16, -1).astype(np.float32)
            if w % 2:
                out[f"{w}:{w - 1}"] = taps[-1].astype(np.float32)
        return out

    def score_texts(self, data: np.ndarray, offsets: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        """Mean log probabilities over all windows of each text (texts x classes)."""
        step = WINDOW - max(WIDTHS) + 1
        size = np.diff(offsets)
        n = np.maximum(1, -(-np.maximum(size - (max(WIDTHS) - 1), 1) // step))  # windows of each text
        doc = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        # the last window ends with its text; a shorter text is padded with spaces
        begin = np.minimum(k * step, np.maximum(size[doc] - WINDOW, 0)) + offsets[:-1][doc]
        padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
        total = np.zeros((len(size), len(self.classes)))
        for lo in range(0, len(doc), 512):
            at = begin[lo : lo + 512, None] + np.arange(WINDOW)
            x = np.where(at < offsets[1:][doc[lo : lo + 512], None], padded[at], 32).astype(np.uint16)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            pooled = []
            for w in WIDTHS:
                m = WINDOW - w + 1
                z = None
                for t in range(0, w, 2):
                    part = tables[f"{w}:{t}"]
                    part = part[pairs[:, t : t + m]] if t + 1 < w else part[x[:, t : t + m]]
                    z = part if z is None else np.add(z, part, out=z)
                pooled.append(z.max(1) + self.p[f"b{w}"])
            h = np.maximum(np.concatenate(pooled, 1), 0)
            np.add.at(total, doc[lo : lo + 512], np.log(softmax(h @ self.p["out"] + self.p["bias"]) + 1e-9))
        return total / n[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def windows_to_learn(docs: DataFrame, label: str, most: int, each: int = 6, seed: int = 1) -> DataFrame:
    """(label, bytes): at most `most` labelled texts by a hash order, `each` windows of each at hashed places.

    Only texts whose hash lies in the first part that holds some 2 * most distinct ones are cut and sorted, so that no task
    receives rows from every partition. Equal texts with one label count once.
    """
    rows = docs.where(F.col(label).isNotNull() & (F.length("text") > 0)).select(F.col(label).alias("label"), "text", F.xxhash64(F.lit(seed), "text").alias("h"))
    some = rows.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    if some > 3 * most:
        rows = rows.where(F.col("h") < F.lit(int(-(1 << 63) + (1 << 64) * (2 * most / some))))
    # windows are cut before the sort, so that no whole text is moved
    cut = [F.encode(F.substring("text", (F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)), "UTF-8") for k in range(each)]
    chosen = rows.select("h", "label", F.array(*cut).alias("cuts")).dropDuplicates(["h", "label"]).orderBy("h", "label").limit(most)
    return chosen.select("label", F.explode("cuts").alias("bytes"))


def train(docs: DataFrame, label: str = "lang", most: int = 3000) -> ByteCnn | None:
    """A network from at most `most` labelled texts (a documented bound on what reaches the driver); None without any."""
    rows = windows_to_learn(docs, label, most).toArrow()
    labels = rows.column("label").to_pylist()
    if not labels:
        return None
    classes = sorted(set(labels))
    x = np.full((len(labels), WINDOW), 32, np.uint8)
    for k, b in enumerate(rows.column("bytes").to_pylist()):
        x[k, : min(len(b), WINDOW)] = np.frombuffer(b[:WINDOW], np.uint8)
    y = np.searchsorted(classes, labels)
    return ByteCnn(classes).fit(x, y)


def predict(docs: DataFrame, model: ByteCnn | None, keep: list[Column | str]) -> DataFrame:
    """Adds lang_pred and score to the kept columns. Every window of the whole text counts.

    A null text, one without a letter, or any text without a model: `und`, score 0.
    """
    schema = docs.select(*keep).schema
    n = len(schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some kB, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(n), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, prob = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in text_slices(batch, "text") if net else ():
                p = softmax(net.score_texts(data, offsets, tables))
                best[lo:hi], prob[lo:hi] = p.argmax(1), p.max(1)
            best[~letters], prob[~letters] = -1, 0
            names = pa.array([net.classes[k] if k >= 0 else "und" for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], names, pa.array(prob)], [*schema.names, "lang_pred", "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, "text").mapInArrow(score, f"{out}, lang_pred string, score double")


def language_id(docs: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents whose crc32(doc_id) mod 3 is not 1.

    A text that is null, empty or without a letter has `und` and score 0, and so have all texts where nothing can be learned
    (no label at all). Long texts are scored over all their windows; of equal scores the language that comes first by
    name counts. A null doc_id is not held out and not learned from. Rows without a label are scored like others. Repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs.where(~out & F.col("doc_id").isNotNull()), "lang", most)
    return predict(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")
