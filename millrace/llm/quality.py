"""Operator 7: quality scores by random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, Scratch, mix64, prefix_hash, range_hash, text_slices, words

FEATURES, RIDGE, BINS, FOLDS = 192, 1e-3, 1000, 4
#: Per byte: which of the counted kinds it is.
_KINDS = np.zeros((256, 8), bool)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz"), 0] = True
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1] = True
_KINDS[list(b"0123456789"), 2] = True
_KINDS[[9, 11, 12, 13, 32], 3] = True
_KINDS[10, 4] = True
_KINDS[list(b".,;:'\"-?"), 5] = True
_KINDS[list(b"!#$%&()*+/<=>@[\\]^_`{|}~"), 6] = True
_KINDS[128:, 7] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x statistics) of whole texts; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    kinds = np.zeros((n, 8))
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(_KINDS[data, k])])
        kinds[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    starts, ends, at = words(data, offsets)
    count = np.diff(at)
    doc = np.repeat(np.arange(n), count)
    w = np.maximum(count, 1)
    length = ends - starts
    mean = np.bincount(doc, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, n) / w - mean**2, 0))
    h = range_hash(prefix_hash(_LOWER[data]), starts, ends)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    # the commonest word's share
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][new], runs)
    first, last = data[starts], data[np.maximum(ends - 1, 0)]
    share = lambda hit: np.bincount(doc[hit], minlength=n) / w
    upper = _KINDS[first, 1]
    marks = _KINDS[last, 6]
    # lines, and those that are repeated within the text
    line_sep = np.zeros(256, bool)
    line_sep[10] = True
    ls, le, lat = words(data, offsets, line_sep)
    lines = np.diff(lat)
    ldoc = np.repeat(np.arange(n), lines)
    lh = range_hash(prefix_hash(data), ls, le)
    lo = np.lexsort((lh, ldoc))
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[lo][1:] != lh[lo][:-1]) | (ldoc[lo][1:] != ldoc[lo][:-1])
    own = np.bincount(ldoc[lo][fresh], minlength=n)
    out = np.column_stack([
        np.log1p(size), np.log1p(count), *(kinds[:, k] / some for k in range(8)), mean / 10, spread / 10, distinct / w, again / w, top / w,
        share(upper), share(marks), share(length >= 20), share(length <= 2), np.log1p(lines), own / np.maximum(lines, 1), count / np.maximum(lines, 1) / 50,
    ])
    out[size == 0] = 0
    return out


class Model:
    """Standardisation, random features of a Gaussian kernel, ridge weights, isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, gamma: float = 0.25, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = r.normal(0, gamma, (len(mean), FEATURES))
        self.b = r.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.value = np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step means of y over sorted x (pool adjacent violators): the blocks' mean x, and their values."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _tree_sum(parts: DataFrame) -> np.ndarray | None:
    """The sum of vectors (binary float64, one a partition), in groups of 32 until few are left for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                v = np.frombuffer(v.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 32:
        n = -(-n // 32)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    got = [np.frombuffer(r["v"], np.float64) for r in parts.collect()]
    return sum(got) if got else None


def _partition_sums(rows: DataFrame, of) -> np.ndarray | None:
    """of(statistics, labels) gives a vector for each batch; their sum over all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                v = of(x, batch.column(1).to_numpy().astype(float))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    return _tree_sum(rows.select("stats", "label").mapInArrow(part, "v binary"))


def folds(x: np.ndarray) -> np.ndarray:
    """The fold of each row, by a hash of its statistics: equal rows are in one fold."""
    return (mix64(np.bitwise_xor.reduce(mix64(np.ascontiguousarray(x).view(np.uint64) + np.arange(x.shape[1], dtype=np.uint64)), axis=1)) % np.uint64(FOLDS)).astype(np.int64)


def fit(rows: DataFrame) -> Model | None:
    """rows: stats and label (0 or 1), all of which count; None if there are none.

    Three passes: means and deviations; normal equations of the random features, summed in each partition;
    a histogram of raw scores and labels for the isotonic steps. There a row has the score that a fit on the
    other folds gives it, so that the steps are not those of rows already seen. What reaches the driver has a
    fixed size.
    """
    moments = _partition_sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if moments is None:
        return None
    n, k = moments[0], (len(moments) - 1) // 2
    mean = moments[1 : k + 1] / n
    model = Model(mean, np.sqrt(np.maximum(moments[k + 1 :] / n - mean**2, 1e-6)))
    m = FEATURES + 1

    def equations(x, y):
        f, of = model.features(x), folds(x)
        parts = ((f[of == k], y[of == k]) for k in range(FOLDS))
        return np.concatenate([v for a, b in parts for v in ([len(a)], (a.T @ a).ravel(), a.T @ b)])

    sums = _partition_sums(rows, equations).reshape(FOLDS, -1)

    def solved(total):
        return np.linalg.solve(total[1 : m * m + 1].reshape(m, m) / total[0] + RIDGE * np.eye(m), total[m * m + 1 :] / total[0])

    every = sums.sum(0)
    model.weights = solved(every)
    # with all rows in one fold there is nothing else to score it by
    others = np.stack([solved(every - s) if every[0] > s[0] else model.weights for s in sums])

    def histogram(x, y):
        raw = np.clip((model.features(x) * others[folds(x)]).sum(1), -0.5, 1.5)
        at = ((raw + 0.5) / 2 * (BINS - 1)).astype(int)
        return np.concatenate([np.bincount(at, w, BINS) for w in (np.ones(len(y)), y, raw)])

    count, good, raw = _partition_sums(rows, histogram).reshape(3, BINS)
    some = count > 0
    model.at, model.value = isotonic(raw[some] / count[some], good[some] / count[some], count[some])
    return model


def _mapped(docs: DataFrame, keep: list[Column | str], name: str, kind, of) -> DataFrame:
    """Adds to the kept columns what `of` makes of the batch's column `text` or `stats` (numpy rows)."""
    schema = docs.select(*keep).schema
    n = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *of(batch.column(n))], names)

    out = T.StructType([*schema.fields, *kind])
    names = out.names
    return docs.select(*keep, name).mapInArrow(run, out)


def _text_statistics(texts: pa.Array) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch, "text")]
    return np.concatenate(parts) if parts else np.empty((0, 0))


def with_statistics(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """Adds stats (array of double) of the whole texts to the kept columns."""

    def of(texts):
        x = _text_statistics(texts)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(x.ravel()))]

    return _mapped(docs, keep, "text", [T.StructField("stats", T.ArrayType(T.DoubleType()))], of)


def predict(docs: DataFrame, model: Model | None, keep: list[Column | str], column: str = "stats", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score and predicted (score >= 0.7) to the kept columns, from stats or text; without a model, score 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some kB, whatever the input

    def of(rows):
        model = sent.value
        out = np.full(len(rows), 0.5)
        if model and len(rows):
            out = model.score(_text_statistics(rows) if column == "text" else rows.flatten().to_numpy().reshape(len(rows), -1))
        return [pa.array(out), pa.array((out >= 0.7).astype(np.int32))]

    return _mapped(docs, keep, column, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], of)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> Model | None:
    """Fit on the labelled documents that are not held out. Only statistics move, never texts."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return fit(scratch.table(stats.where(~held_out()).join(known, "doc_id").select("stats", "label"), "labelled"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels with crc32(doc_id) mod 4 not 2.

    Null and empty texts have the statistics 0 and the score of those. A null doc_id has no label. A document
    with several labels counts with the largest. Repeated rows stay; an empty table gives no rows. Texts are
    read once: their statistics are written, and serve for learning and for scoring.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(with_statistics(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")]), "statistics")
    return predict(stats, learn(stats, labels, scratch), ["doc_id", "held_out"])


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that are predicted to be good.

    Null and empty texts are judged as such. Without a usable label nothing is learned, and all documents stay. An empty
    table gives no rows; a null doc_id has no label but is judged like others.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(with_statistics(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "statistics")
    model = learn(stats, labels, scratch)
    if model is None:
        return docs
    names = docs.columns
    return predict(docs, model, names, "text", ("__score", "__predicted")).where("__predicted = 1").select(*names)
