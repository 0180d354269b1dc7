"""Operator 1: token ids as length-delimited binary records with masked checksums and a separate offset index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import Words

#: One row of an index file: the document, where its record begins, and its number of ids.
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])
#: Fixed values of the record format: the CRC-32C polynomial (reflected) and the mask added after a rotation by 15.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
_BLOCK = 64


def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    base = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        base = np.where(base & 1, (base >> 1) ^ np.uint32(POLYNOMIAL), base >> 1).astype(np.uint32)
    step = lambda v: (v >> np.uint32(8)) ^ base[v & np.uint32(255)]  # noqa: E731  one zero byte further
    at = np.empty((_BLOCK, 256), np.uint32)
    at[-1] = base
    for k in range(_BLOCK - 2, -1, -1):
        at[k] = step(at[k + 1])
    shift = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    for _ in range(_BLOCK):
        shift = step(shift)
    shifts = [shift]  # by 64 bytes, 128 bytes, ...
    for _ in range(30):
        shifts.append(_apply(shifts[-1], shifts[-1]))
    return base, at, shifts


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


_BASE, _AT, _SHIFTS = _tables()


def checksums(records: list[bytes | memoryview]) -> np.ndarray:
    """The CRC-32C of each record, in blocks of 64 bytes that are reduced side by side and then moved to their places."""
    sizes = np.array([len(r) for r in records], np.int64)
    out = np.empty(len(records), np.uint32)
    for i in np.flatnonzero(sizes < 4).tolist():
        c = 0xFFFFFFFF
        for b in bytes(records[i]):
            c = (c >> 8) ^ int(_BASE[(c ^ b) & 255])
        out[i] = c ^ 0xFFFFFFFF
    some = np.flatnonzero(sizes >= 4)
    if len(some):
        m = -(-sizes[some] // _BLOCK)
        ends = np.cumsum(m)
        data = np.zeros(int(ends[-1]) * _BLOCK, np.uint8)  # zeros in front of a record change nothing while the state is 0
        for i, end in zip(some.tolist(), (ends * _BLOCK).tolist()):
            data[end - len(records[i]) : end] = np.frombuffer(records[i], np.uint8)
        first = ends * _BLOCK - sizes[some]
        data[first[:, None] + np.arange(4)] ^= 255  # the state that a checksum begins with
        columns = np.ascontiguousarray(data.reshape(-1, _BLOCK).T)
        blocks = _AT[0].take(columns[0])
        for k in range(1, _BLOCK):
            blocks ^= _AT[k].take(columns[k])
        far = np.repeat(ends, m) - 1 - np.arange(int(ends[-1]))
        k = 0
        while int(m.max()) - 1 >> k:
            hit = (far >> k) & 1 == 1
            blocks[hit] = _apply(_SHIFTS[k], blocks[hit])
            k += 1
        out[some] = np.bitwise_xor.reduceat(blocks, ends - m) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(records: list[bytes | memoryview]) -> list[bytes]:
    """The masked checksum of each record as 4 bytes."""
    c = checksums(records)
    raw = (((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK)).astype("<u4").tobytes()
    return [raw[k : k + 4] for k in range(0, len(raw), 4)]


def crc32c(record: bytes) -> int:
    return int(checksums([record])[0])


def frames(records: list[bytes]) -> list[bytes]:
    """Length (8 bytes), its masked checksum (4), the record, its masked checksum (4); all little-endian."""
    sizes = [len(r).to_bytes(8, "little") for r in records]
    return [b"".join(parts) for parts in zip(sizes, masked(sizes), records, masked(records))]


def frame(record: bytes) -> bytes:
    return frames([record])[0]


def unframed(data: bytes | memoryview, offsets: list[int]) -> list[bytes]:
    """The records at the offsets; ValueError if a checksum is wrong or the file ends early."""
    sizes = [bytes(data[o : o + 8]) for o in offsets]
    for o, size, sum_ in zip(offsets, sizes, masked(sizes)):
        if len(size) < 8 or data[o + 8 : o + 12] != sum_:
            raise ValueError(f"bad length at {o}")
    records = [bytes(data[o + 12 : o + 12 + int.from_bytes(size, "little")]) for o, size in zip(offsets, sizes)]
    for o, size, record, sum_ in zip(offsets, sizes, records, masked(records)):
        if len(record) < int.from_bytes(size, "little") or data[o + 12 + len(record) : o + 16 + len(record)] != sum_:
            raise ValueError(f"bad record at {o}")
    return records


def unframe(data: bytes | memoryview, offset: int) -> bytes:
    return unframed(data, [offset])[0]


def filesystem(uri: str):
    """(file system, path) of a folder that all executors reach."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Write documents' token ids as shards of records in ascending doc_id order; return the manifest.

    docs has doc_id and text (further columns are ignored). The manifest has a row (shard, path, documents,
    ids) for each shard in order: its size depends on the number of shards alone. Documents are dealt to
    shards by ranges of doc_id, so that only one shuffle of the texts is needed and nothing is encoded twice. A shard's files get their names by a rename when they are whole; a repeated or speculative task
    writes other names, and the manifest names those of the task that counted.

    Null text: only the end id. Null doc_id: first. Repeated ids or rows: all are written; those of one doc_id are ordered
    by the first 64 characters of their texts, and by whole texts in a shard (a hot doc_id fills several). Empty table: no shard.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hot doc_id, or null, goes to several shards by the beginning of its texts, and copies of one row by their number
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first(F.left("text", F.lit(64)))]
    dealt = dealt.repartitionByRange(n, *order, "at").drop("at").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.load(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        fs, root = filesystem(folder)
        out, name, index, at, ids, of = None, "", [], 0, 0, 0
        held: list[tuple[int | None, bytes]] = []

        def flush():
            nonlocal at, ids
            for (doc, record), framed in zip(held, frames([r for _, r in held])):
                out.write(framed)
                index.append((doc if doc is not None else 0, doc is not None, at, count := len(record) // words.dtype.itemsize))
                at, ids = at + len(framed), ids + count
            held.clear()

        def close():
            flush()
            out.close()
            with fs.open_output_stream(f"{name}.idx.part") as f:
                f.write(np.array(index, INDEX).tobytes())
            for kind in ("idx", "rec"):
                fs.move(f"{name}.{kind}.part", f"{name}.{kind}")

        for batch in batches:
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    of = TaskContext.get().partitionId()
                    name = f"{root}/tokens-{of:06d}-{uuid.uuid4().hex}"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.rec.part", buffer_size=1 << 20)
                held.append((doc, words.encode(text.as_py() or "") + end))
                size += len(held[-1][1])
                if size > 1 << 20:  # records are summed together, by the megabyte
                    flush()
                    size = 0
            if out is not None:
                flush()
        if out is not None:
            close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([of], pa.int32()), "path": [name], "documents": [len(index)], "ids": [ids]})

    return sorted((r["shard"], r["path"], r["documents"], r["ids"]) for r in dealt.mapInArrow(write, "shard int, path string, documents long, ids long").collect())


def read_records(spark, folder: str, manifest: list[tuple[int, str, int, int]], tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the records of the shards, found through the index and verified.

    start is the number of ids in all records before; ids are packed as little-endian unsigned 32-bit.
    """
    rows, start = [], 0
    for _, path, documents, ids in manifest:
        rows.append((path, start))
        start += ids
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    itemsize = Words(tokenizer).dtype.itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                index = np.frombuffer(fs.open_input_stream(f"{name}.idx").read(), INDEX)
                starts = first + np.cumsum(index["n_tokens"]) - index["n_tokens"]
                with fs.open_input_file(f"{name}.rec") as f:
                    for lo in range(0, len(index), 500):
                        part = index[lo : lo + 500]
                        begin = int(part["offset"][0])
                        until = int(part["offset"][-1] + part["n_tokens"][-1] * itemsize + 16)
                        f.seek(begin)
                        data = memoryview(f.read(until - begin))
                        records = [np.frombuffer(r, f"<u{itemsize}").astype("<u4").tobytes() for r in unframed(data, (part["offset"] - begin).tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], mask=part["has_id"] == 0), pa.array(starts[lo : lo + 500]), pa.array([len(r) // 4 for r in records], pa.int64()), pa.array(records, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return spark.createDataFrame(rows, "path string, first long").repartition(len(rows)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the records into the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Every row has a record: null and empty texts the end id alone, repeated rows one each; a null doc_id stays null and
    comes first. An empty table gives no rows; other columns are ignored. Order among equal doc_ids: see write_records.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = write_records(docs, scratch.path("records"), tokenizer, end_id)
    found = read_records(docs.sparkSession, scratch.path("records"), manifest, tokenizer)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
