"""Operator 13: vectors as codes of eight parts, by Elkan's form of Lloyd's rounds over integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch

PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096
#: Bounds are whole numbers of a unit of distance, and no distance of the input has more than this many.
BOUND_STEPS = 65_000
#: How far a square root may be off, relatively, when a bound is rounded outward.
SLACK = 1e-12


@dataclass(frozen=True)
class Scale:
    """What all rounds of a table share: width of a part, type of its components, length of a unit of bounds."""

    width: int
    kind: np.dtype
    unit: float

    def up(self, squared: np.ndarray) -> np.ndarray:
        return np.ceil(np.sqrt(squared.astype(float)) * (1 + SLACK) / self.unit).astype(np.int32)

    def down(self, squared: np.ndarray) -> np.ndarray:
        return np.floor(np.sqrt(squared.astype(float)) * (1 - SLACK) / self.unit).astype(np.int32)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, as integers."""
    d = a - b
    return np.einsum("...w,...w->...", d, d)


def assign_all(x: np.ndarray, book: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), its squared distance, upper bound and lower bounds of one part's rows."""
    d2 = np.stack([_squared(x, entry) for entry in book], 1)
    at = d2.argmin(1)
    own = d2[np.arange(len(x)), at]
    return at, own, scale.up(own), scale.down(d2)


def reassign(x: np.ndarray, book: np.ndarray, was: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after the entries moved from `was` to `book`; returns new (at, upper, lower).

    Bounds follow the movement. An entry is passed over only where the bounds prove it strictly farther; whatever is
    compared is compared as integers, so that a tie goes to the lower index.
    """
    moved = scale.up(_squared(book, was))
    upper, lower = upper + moved[at], np.maximum(lower - moved, 0)
    half = np.floor(np.sqrt(_squared(book[:, None], book[None]).astype(float)) * (1 - SLACK) / 2 / scale.unit).astype(np.int32)
    np.fill_diagonal(half, np.iinfo(np.int32).max)
    rows = np.flatnonzero(upper >= half.min(1)[at])
    own = _squared(x[rows], book[at[rows]])
    upper[rows] = scale.up(own)
    left = upper[rows] >= half.min(1)[at[rows]]
    rows, own = rows[left], own[left]
    for j in range(len(book)):
        a, u = at[rows], upper[rows]
        asked = np.flatnonzero((a != j) & (u >= lower[rows, j]) & (u >= half[a, j]))
        there = rows[asked]
        d2 = _squared(x[there], book[j])
        lower[there, j] = scale.down(d2)
        nearer = (d2 < own[asked]) | (d2 == own[asked]) & (j < at[there])
        at[there[nearer]], own[asked[nearer]] = j, d2[nearer]
        upper[there[nearer]] = scale.up(d2[nearer])
    return at, upper, lower


def _kept(table: DataFrame) -> DataFrame:
    finite = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(finite)


def _integers(vectors: list, scale: Scale) -> np.ndarray:
    """(vectors x parts x width); shorter vectors end in zeros."""
    out = np.zeros((len(vectors), PARTS * scale.width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return np.floor(out * UNIT).astype(np.int64).reshape(len(vectors), PARTS, scale.width)


def _of_batch(column: pa.Array, scale: Scale) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == PARTS * scale.width).all():
        return np.floor(flat * UNIT).astype(np.int64).reshape(len(lengths), PARTS, scale.width)
    return _integers(np.split(flat, np.cumsum(lengths)[:-1]), scale)


def _binary(x: np.ndarray, kind) -> pa.Array:
    """A row of x as one binary value."""
    raw = np.ascontiguousarray(x.astype(kind)).reshape(len(x), -1).view(np.uint8)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * raw.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), *shape)


STATE = ["vec_id", "label", "v", "at", "upper", "lower"]


def first_round(kept: DataFrame, books: np.ndarray, scale: Scale) -> DataFrame:
    """Each vector's integers, assignments and bounds: one upper bound a part, and one lower bound an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _of_batch(batch.column(2), scale)
                at, _, upper, lower = zip(*(assign_all(x[:, p], books[p], scale) for p in range(PARTS)))
                yield _state(batch, x, at, upper, lower, scale)

    return kept.mapInArrow(run, _schema(kept, "v binary, at binary, upper binary, lower binary"))


def _state(batch: pa.RecordBatch, x: np.ndarray, at, upper, lower, scale: Scale) -> pa.RecordBatch:
    bounds = lambda b: np.minimum(np.stack(b, 1), 2 * BOUND_STEPS)
    columns = [batch.column(0), batch.column(1), _binary(x, scale.kind), _binary(np.stack(at, 1), np.uint8), _binary(bounds(upper), np.int32), _binary(np.minimum(bounds(lower), 65_535), np.uint16)]
    return pa.RecordBatch.from_arrays(columns, STATE)


def _schema(kept: DataFrame, more: str) -> StructType:
    return StructType([StructField("vec_id", LongType()), kept.schema["label"], *StructType.fromDDL(more)])


def _moved_on(batch: pa.RecordBatch, was: np.ndarray, books: np.ndarray, scale: Scale) -> tuple[np.ndarray, list]:
    x = _unpacked(batch.column(2), scale.kind, (PARTS, scale.width)).astype(np.int64)
    at = _unpacked(batch.column(3), np.uint8, (PARTS,)).astype(np.int64)
    upper = _unpacked(batch.column(4), np.int32, (PARTS,))
    lower = _unpacked(batch.column(5), np.uint16, (PARTS, books.shape[1])).astype(np.int32)
    return x, [reassign(x[:, p], books[p], was[p], at[:, p].copy(), upper[:, p], lower[:, p], scale) for p in range(PARTS)]


def next_round(state: DataFrame, was: np.ndarray, books: np.ndarray, scale: Scale) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, parts = _moved_on(batch, was, books, scale)
                yield _state(batch, x, *zip(*parts), scale)

    return state.select(*STATE).mapInArrow(run, state.schema)


def codes(state: DataFrame, was: np.ndarray, books: np.ndarray, scale: Scale) -> DataFrame:
    """(vec_id, label, code, error) of the last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, parts = _moved_on(batch, was, books, scale)
                at = np.stack([p[0] for p in parts], 1)
                error = sum(_squared(x[:, p], books[p][at[:, p]]) for p in range(PARTS))
                code = [row.tobytes().hex() for row in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.select(*STATE).mapInArrow(run, _schema(state, "code string, error long"))


def moved_entries(state: DataFrame, books: np.ndarray, scale: Scale) -> np.ndarray:
    """The entries as means of their parts, rounded down; unused ones stay.

    Every task sums its rows by part and entry; what reaches the driver has the size of the codebooks.
    """
    n_entries, width = books.shape[1:]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * n_entries, width + 1), np.int64)
        for batch in batches:
            if len(batch):
                x = _unpacked(batch.column(0), scale.kind, (PARTS, width)).astype(np.int64)
                slot = _unpacked(batch.column(1), np.uint8, (PARTS,)).astype(np.int64) + n_entries * np.arange(PARTS)
                order = np.argsort(slot.ravel(), kind="stable")
                ranked = slot.ravel()[order]
                first = np.flatnonzero(np.diff(ranked, prepend=-1))
                total[ranked[first], :width] += np.add.reduceat(x.reshape(-1, width)[order], first)
                total[ranked[first], width] += np.diff(np.append(first, len(ranked)))
        slot, place = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "place": pa.array(place), "total": pa.array(total[slot, place])})

    found = state.select("v", "at").mapInArrow(sums, "slot long, place long, total long").groupBy("slot", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((PARTS * n_entries, width + 1), np.int64)
    for r in found:
        total[r.slot, r.place] = r.total
    used = total[:, width] > 0
    out = books.reshape(PARTS * n_entries, width).copy()
    out[used] = total[used, :width] // total[used, width:]
    return out.reshape(books.shape)


def vector_codes(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is whole and finite.

    Each part's codebook starts as that part of the vectors with the 16 smallest vec_ids (null last; of equal ones the
    lesser vector first) and is moved six times. Rows alike each have a code. Fewer than 16 vectors make fewer entries.
    Vectors shorter than the widest, or than a multiple of 8, are filled up with zeros at their ends. Null labels are
    one label. No vector left: no rows. Other columns are ignored. Components so large that a squared distance could
    pass 64 bits raise a ValueError: there is no right result to give.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "codes")
    kept = _kept(table)
    most = kept.agg(F.max(F.size("embedding")).alias("size"), F.max(F.expr("array_max(transform(embedding, x -> abs(x)))")).alias("largest")).first()
    if most["size"] is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-most["size"] // PARTS))
    largest = int((most["largest"] or 0.0) * UNIT) + 1
    if PARTS * width * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError(f"components of {most['largest']} make distances of more than 64 bits")
    kind = next(np.dtype(k) for k in (np.int16, np.int32, np.int64) if largest <= np.iinfo(k).max)
    scale = Scale(width, kind, max(1.0, 2 * largest * width**0.5 / BOUND_STEPS))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).collect()
    books = np.ascontiguousarray(_integers([r.embedding for r in first], scale).transpose(1, 0, 2))
    state = scratch.table(first_round(kept, books, scale), "round-1")
    for k in range(2, ROUNDS + 2):
        was, books = books, moved_entries(state, books, scale)
        if k <= ROUNDS:
            state = scratch.table(next_round(state, was, books, scale), f"round-{k}")
            scratch.drop(f"round-{k - 1}")
    coded = scratch.table(codes(state, was, books, scale), "coded")
    scratch.drop(f"round-{ROUNDS}")
    # written, so that its size is known: the codes are shuffled only where labels are too many to send to all
    of_label = scratch.table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
