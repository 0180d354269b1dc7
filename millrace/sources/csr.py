"""Token arrays as flat files: a Spark data source that writes and reads compressed sparse rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The file that makes a folder readable; it names the parts, in order.
MANIFEST = "_parts.json"
SCHEMA = "id long, tokens array<int>, start long"
#: Tokens of one batch that is read.
SLICE = 1 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    tokens: int


class CsrWriter(DataSourceArrowWriter):
    """Each task streams its rows into three files under a name of its own; only commit, on the driver, makes them readable.

    name.tokens: unsigned 32-bit ids; name.offsets: 64-bit ends; name.ids: 64-bit ids of rows; all little-endian.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        store, root = filesystem(self.path)
        part = Part(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0, 0)
        store.create_dir(root, recursive=True)
        names = [f"{root}/{part.name}.{kind}" for kind in ("tokens", "offsets", "ids")]
        files = [store.open_output_stream(n) for n in names]
        try:
            for batch in iterator:
                ids, lists = batch.column("id"), batch.column("tokens")
                if ids.null_count or lists.null_count or lists.flatten().null_count:
                    raise ValueError("ids and token arrays must not be null")
                tokens = lists.flatten().to_numpy(zero_copy_only=False)
                if len(tokens) and tokens.min() < 0:
                    raise ValueError("token ids must not be negative")
                ends = part.tokens + np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
                for f, x, kind in zip(files, (tokens, ends, ids.to_numpy(zero_copy_only=False)), ("<u4", "<i8", "<i8")):
                    f.write(np.ascontiguousarray(x.astype(kind)).tobytes())
                part.rows, part.tokens = part.rows + len(ids), part.tokens + len(tokens)
            for f in files:
                f.close()
        except BaseException:
            for f, n in zip(files, names):
                f.close()
                store.delete_file(n)
            raise
        return part

    def commit(self, messages: list[Part | None]) -> None:
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} has been written before")
        parts = [vars(m) for m in messages if m is not None]
        with store.open_output_stream(f"{root}/{MANIFEST}.part") as f:
            f.write(json.dumps(parts).encode())
        store.move(f"{root}/{MANIFEST}.part", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for kind in ("tokens", "offsets", "ids") if m is not None else ():
                store.delete_file(f"{root}/{m.name}.{kind}")


@dataclass
class Stretch(InputPartition):
    name: str
    first: int
    rows: int


class CsrReader(DataSourceReader):
    """One partition a part; start is the place of a row's first token in all parts together."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Stretch]:
        store, root = filesystem(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            parts = json.loads(f.read())
        before, out = 0, []
        for p in parts:
            out.append(Stretch(p["name"], before, p["rows"]))
            before += p["tokens"]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(self.path)
        load = lambda kind: np.frombuffer(store.open_input_stream(f"{root}/{partition.name}.{kind}").read(), "<i8")
        ids, ends = load("ids"), load("offsets")
        if len(ids) != partition.rows or len(ends) != partition.rows:
            raise ValueError(f"{partition.name} is not whole")
        offsets = np.concatenate([[0], ends])
        lo = 0
        with store.open_input_file(f"{root}/{partition.name}.tokens") as f:
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
                raw = f.read_at(int(offsets[hi] - offsets[lo]) * 4, int(offsets[lo]) * 4)
                lists = pa.ListArray.from_arrays(pa.array((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)), pa.array(np.frombuffer(raw, "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), lists, pa.array(partition.first + offsets[lo:hi])], ["id", "tokens", "start"])
                lo = hi


class Csr(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        store, root = filesystem(self.options["path"])
        if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.options['path']} has been written before")
        return CsrWriter(self.options["path"])


def write_csr(rows: DataFrame, path: str) -> None:
    """rows (id, tokens) in order of id; a path that has been written is refused, a failed write leaves nothing to read."""
    rows.sparkSession.dataSource.register(Csr)
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("tokens").cast("array<int>").alias("tokens"))
    own.repartitionByRange("id").sortWithinPartitions("id").write.format("csr").mode("append").save(path)


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(id, tokens, start) in the order that was written."""
    spark.dataSource.register(Csr)
    return spark.read.format("csr").load(path)
