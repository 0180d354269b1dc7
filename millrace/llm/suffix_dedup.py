"""Operator 6: removal of every byte that lies in a string of 200 bytes (or another length) which also starts elsewhere.

Prefix doubling over the positions whose strings can repeat: a position has a rank, which equal beginnings share; in each
turn the pair of its rank and the rank at the offset that the last turn reached is ranked anew, positions with a unique pair
leave, and the loop ends when none is left or the length is reached. Ranks are 64-bit names of content, so that a
position carries the ranks at its offsets and no turn joins it to another position; they tell equal from different, which
is all that is asked, but have no order.

Positions reach that loop only where anchors leave it open (doubling at every byte needs some 50 x the input as shuffle):
each string has one anchor (the smallest hash among its 48-byte pieces, the leftmost of equals), equal strings have equal
anchors, and neighbouring strings with one anchor form a segment. A segment whose anchor occurs once in the corpus is
unique at length 48 and leaves at once; segments that are equal as a whole are counted as a whole. Different segments
with one anchor are taken apart, first into blocks of 16 strings at equal places from the anchor: a block whose strings
share a unique core leaves, equal blocks are counted as a whole, and the strings of what is left become positions.
Names are compared among equal anchors only, so that two strings count as equal by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import INVERSE, U64, Scratch, mix64, powers, prefix_hash, range_hash, signed, text_slices

#: Bytes of a piece that can anchor, of the first ranks; strings in a block; bytes of text that are taken at once.
PIECE, FIRST, BLOCK, CHUNK = 48, 50, 16, 1 << 19
SHORTEST = 32


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, number of strings, anchor hash, content hash of each segment of concatenated texts (CHUNK bytes or so)."""
    none = np.empty(0, np.int64)
    n = len(data) - length + 1
    if n < 1:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    size = min(PIECE, length)
    m = len(data) - size + 1
    piece = mix64((prefix[size:] - prefix[:m]) * powers(INVERSE, m))
    low = (piece >> U64(20) << U64(20)) | np.arange(m, dtype=np.uint64)
    span, width = 1, length - size + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n], low[width - span : width - span + n])
    anchor = (low[:n] & U64((1 << 20) - 1)).astype(np.int64)
    size = np.diff(offsets)
    edge = np.zeros(len(data) + 1, np.int8)
    fits = size >= length
    np.add.at(edge, offsets[:-1][fits], 1)
    np.add.at(edge, offsets[:-1][fits] + size[fits] - length + 1, -1)
    valid = np.cumsum(edge[:n], dtype=np.int8) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(first)
    stop = np.append(start[1:], n)
    total = np.concatenate([[0], np.cumsum(valid)])
    count = total[stop] - total[start]
    return start, count, piece[anchor[start]], range_hash(prefix, start, start + count + length - 1)


def _key(docs: DataFrame) -> DataFrame:
    """Rows with one doc_id and one text are alike, so that (d, k) serves as the key of either."""
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), "text")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["d"].eqNullSafe(b["d"]) & (a["k"] == b["k"])


def corpus_segments(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "text", CHUNK):
                # a longer text is taken in chunks that share length - 1 bytes, so that each string lies in one
                chunks = [(0, data, offsets)] if len(data) <= 2 * CHUNK else [(c, part := data[c : c + CHUNK + length - 1], np.array([0, len(part)])) for c in range(0, len(data), CHUNK)]
                for base, part, offs in chunks:
                    start, count, anchor, content = segments(part, offs, length)
                    row = np.searchsorted(offs, start, "right") - 1
                    take = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array((start - offs[row] + base).astype(np.int64)), pa.array(count.astype(np.int32)), signed(anchor), signed(content)],
                        ["d", "k", "off", "n", "anchor", "content"],
                    )

    return _key(docs).mapInArrow(cut, "d long, k long, off long, n int, anchor long, content long")


def _cut_out(length: int):
    """The bytes of segments, and how far the anchor lies from their beginning."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode("utf-8", "replace")
                for w in wanted.as_py():
                    part = data[w["off"] : w["off"] + w["n"] + length - 1]
                    prefix = prefix_hash(np.frombuffer(part, np.uint8))
                    size = min(PIECE, length)
                    m = min(length, len(part)) - size + 1
                    piece = mix64((prefix[size : size + m] - prefix[:m]) * powers(INVERSE, m)).view(np.int64)
                    rows.append((w["anchor"], w["content"], w["times"], w["n"], int(np.flatnonzero(piece == w["anchor"])[0]), part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["anchor", "content", "times", "n", "lead", "bytes"])

    return cut


def _blocks(length: int):
    """A segment's strings in blocks of BLOCK by their place relative to the anchor, alike in all segments of it.

    core names the bytes that all strings of the block share, whole those that any of them has.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for n, lead, part in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                prefix = prefix_hash(np.frombuffer(part, np.uint8))
                b = np.arange(-lead // BLOCK, (n - 1 - lead) // BLOCK + 1)
                j0, j1 = np.maximum(b * BLOCK + lead, 0), np.minimum(b * BLOCK + BLOCK - 1 + lead, n - 1)
                core = range_hash(prefix, b * BLOCK + BLOCK - 1 + lead, b * BLOCK + length + lead)
                whole = mix64(range_hash(prefix, j0, j1 + length) + ((j0 - lead) * 1024 + j1 - lead).astype(np.uint64))
                for k, x in enumerate((b, j0, j1, core.view(np.int64), whole.view(np.int64), np.full(len(b), len(out[0])))):
                    out[k].append(x)
            if out[0]:
                b, j0, j1, core, whole, row = map(np.concatenate, out)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), *(pa.array(x.astype(np.int32)) for x in (b, j0, j1)), pa.array(core), pa.array(whole)], ["anchor", "content", "times", "b", "j0", "j1", "core", "whole"])

    return block


def doublings(length: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the rank that each turn adds: the one at the reach of the last turn, or as far as the length allows."""
    out, reach = [], min(FIRST, length)
    while reach < length:
        offset = min(reach, length - reach)
        out.append((offset, reach))
        reach += offset
    return out


def _ranks(length: int):
    """For single strings of segments: their first rank, and those that the turns add."""
    parts = [(0, min(FIRST, length)), *doublings(length)]
    names = [f"r{t}" for t in range(len(parts))]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, js, ranks = [], [], []
            for k, (part, ranges) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                prefix = prefix_hash(np.frombuffer(part, np.uint8))
                j = np.concatenate([np.arange(r["j0"], r["j1"] + 1) for r in ranges])
                js.append(j)
                rows.append(np.full(len(j), k))
                ranks.append(np.stack([range_hash(prefix, j + at, j + at + size) for at, size in parts]))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array(np.concatenate(js).astype(np.int32)), *map(signed, np.concatenate(ranks, 1))], ["anchor", "content", "times", "j", *names])

    return name, ", ".join(["anchor long, content long, times long, j int", *(f"{c} long" for c in names)])


def doubled(at: DataFrame, turns: int, scratch: Scratch) -> DataFrame:
    """The positions (anchor, content, j) whose strings repeat: rank pairs are ranked anew until unique or of full length."""
    now = at.withColumnRenamed("r0", "rank")
    for t in range(turns + 1):
        if t:
            now = now.withColumn("rank", F.xxhash64("rank", f"r{t}")).drop(f"r{t}")
        ranks = scratch.table(now.groupBy("anchor", "rank").agg(F.sum("times").alias("seen")).where("seen > 1").select("anchor", "rank"), f"ranks-{t}")
        if t < turns and not ranks.limit(1).count():
            return now.where("false").select("anchor", "content", "j")
        now = now.join(ranks, ["anchor", "rank"])
    return now.select("anchor", "content", "j")


def repeated_spans(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(d, k, spans): for documents with repeated strings, the byte ranges that those cover."""
    seg = scratch.table(corpus_segments(docs, length), "segments")
    # written before the join: a hot anchor's rows can then be split among tasks
    anchors = seg.groupBy("anchor").agg(F.count("*").alias("total"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("total > 1")
    anchors = scratch.table(anchors.select("anchor", (F.col("c0") < F.col("c1")).alias("mixed")), "anchors")
    held = scratch.table(seg.join(anchors, "anchor"), "held")
    scratch.drop("segments", "anchors")
    whole = held.where("NOT mixed").select("d", "k", F.col("off").alias("s"), (F.col("off") + F.col("n") + length - 1).alias("e"))
    # one example of each different segment, from one row (first() of one aggregation come from one row)
    kinds = held.where("mixed").groupBy("anchor", "content").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("d", "k", "off", "n")))
    asked = kinds.groupBy("d", "k").agg(F.collect_list(F.struct("off", "n", "anchor", "content", "times")).alias("wanted"))
    texts = _key(docs)
    # rows of equal keys have equal segments: each is named once
    mixed = texts.join(asked, _same(texts, asked)).select("text", "wanted").mapInArrow(_cut_out(length), "anchor long, content long, times long, n int, lead int, bytes binary")
    mixed = scratch.table(mixed, "mixed")
    blocks = scratch.table(mixed.mapInArrow(_blocks(length), "anchor long, content long, times long, b int, j0 int, j1 int, core long, whole long"), "blocks")
    cores = blocks.groupBy("anchor", "b", "core").agg(F.sum("times").alias("seen"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("seen > 1")
    cores = scratch.table(cores.select("anchor", "b", "core", (F.col("w0") == F.col("w1")).alias("equal")), "cores")
    alive = scratch.table(blocks.join(cores, ["anchor", "b", "core"]).select("anchor", "content", "j0", "j1", "equal"), "alive")
    open_ = alive.where("NOT equal").groupBy("anchor", "content").agg(F.collect_list(F.struct("j0", "j1")).alias("ranges"))
    name, schema = _ranks(length)
    at = scratch.table(mixed.join(open_, ["anchor", "content"]).select("anchor", "content", "times", "bytes", "ranges").mapInArrow(name, schema), "positions")
    single = doubled(at, len(doublings(length)), scratch).select("anchor", "content", F.col("j").alias("j0"), (F.col("j") + 1).alias("j1"))
    found = single.union(alive.where("equal").select("anchor", "content", "j0", F.col("j1") + 1)).groupBy("anchor", "content").agg(F.collect_list(F.struct("j0", "j1")).alias("js"))
    found = scratch.table(found.mapInArrow(_runs, "anchor long, content long, j0 int, j1 int"), "found")
    partly = held.where("mixed").join(found, ["anchor", "content"]).select("d", "k", (F.col("off") + F.col("j0")).alias("s"), (F.col("off") + F.col("j1") + length - 1).alias("e"))
    return whole.union(partly).groupBy("d", "k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (s, e) of all rows of a list column, overlapping and touching ones as one: row, s, e in order."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    # rows are laid behind each other, so that one pass serves all
    far = row.astype(np.int64) << 40
    s, e = (values.field(k).to_numpy().astype(np.int64) + far for k in range(2))
    order = np.argsort(s, kind="stable")
    s, reach = s[order], np.maximum.accumulate(e[order]) if len(e) else e
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s))[: len(first)] - 1
    row = s[first] >> 40
    return row, s[first] - (row << 40), reach[last] - (row << 40)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, s, e = merged(batch.column(2))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["anchor", "content", "j0", "j1"])


def remove_repeats(docs: DataFrame, length: int = 200, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for) of every document.

    Null and empty texts, and those shorter than `length`: nothing is removed. Repeated rows are copies of each
    other, and so are removed whole where they are long enough. An empty table gives no rows; other columns are
    ignored. `length` is any number from 32 on.
    """
    if length < SHORTEST:
        raise ValueError(f"length must be {SHORTEST} or more")
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = scratch.table(repeated_spans(docs, length, scratch), "spans")
    scratch.drop("held", "mixed", "blocks", "cores", "alive", "positions", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, sha, left = [], [], [], [], []
            row, s, e = merged(batch.column(2))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            s, e = s.tolist(), e.tolist()
            for k, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                a, b = s[at[k] : at[k + 1]], e[at[k] : at[k + 1]]
                kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)]))
                n.append(len(data))
                removed.append(len(data) - len(kept))
                count.append(len(a))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if keep_bytes else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = _key(docs)
    both = texts.join(spans.hint("shuffle_hash"), _same(texts, spans), "left").select(texts["d"], "text", F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"))
    out = both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
