"""What the llm operators share: shared scratch tables, batches of bytes, hashes, link components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows of one Arrow batch; a batch of long texts must still fit beside a second worker in an executor.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set in the context.

    Only a session that runs in one process may do without, and has a temporary folder then.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables of one run in the shared folder: written, so that lineage ends there, and read again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs; without names, all."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for name in names or ("",):
                path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
                path.getFileSystem(conf).delete(path, True)
        except Exception as e:  # at exit the JVM may be gone; the shared folder outlives a run anyway
            if names:
                raise RuntimeError(f"scratch tables {names} could not be deleted") from e


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `most` bytes; null texts are empty.

    A longer text is a run of its own; no text is cut.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so that powers can be inverted modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers: n + 1 values, from which the hash of any range follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal ranges, equal values."""
    h = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mix64(h + (end - start).astype(np.uint64) * U64(0xA0761D6478BD642F))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in concatenated texts, and the number of words before each text."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = cut[cut > 0] - 1
    last[ends_at] = inside[ends_at]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, separators: np.ndarray = _SPACE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of lower-cased (A-Z) texts, and the number of shingles before each text.

    A text with fewer words than `width` has its whole sequence as one shingle (none if `short` is false).
    """
    low = _LOWER[data]
    starts, ends, at = words(low, offsets, separators)
    w = range_hash(prefix_hash(low), starts, ends)
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, (counts > 0) & short).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    pos = at[:-1][doc] + (np.arange(before[-1]) - before[:-1][doc])
    size = np.minimum(width, counts[doc])
    h = size.astype(np.uint64) * U64(0xE7037ED1A0B428DB)
    for k in range(width):
        inside = k < size
        h = np.where(inside, mix64(h * U64(0x8EBC6AF09C88C6E3) + w[np.minimum(pos + k, max(len(w) - 1, 0))]), h) if len(w) else h
    return h, before


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the smallest id reachable over `edges` (a, b); ids without an edge have no row.

    Labels go to the smallest neighbour and then jump along labels, so that the number of rounds grows with
    the logarithm of a chain's length. Each round is a written table. Only counts reach the driver.
    """
    both = scratch.table(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        # a label is itself an id of the component: its own label is a shortcut
        jump = step.join(labels.select(F.col("id").alias("c"), F.col("component").alias("cc")), "c", "left").select("id", "was", F.least("c", F.coalesce("cc", "c")).alias("component"))
        new = scratch.table(jump, f"{name}-{k}")
        moved = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        scratch.drop(f"{name}-{k - 1}")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels


def merged(labels: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) over the links that gave `labels` and `edges` (a, b) together.

    The loop runs over links between components alone: links that were followed before are not read again.
    """
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    joined = components(between, scratch, name)
    # a component's name is its smallest id: it is in labels itself, and names without a label were single ids
    old = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return scratch.table(old.union(joined.join(labels, "id", "left_anti").select("id", "component")), f"{name}-merged")


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, central: Callable[[DataFrame], DataFrame] | None, finer: Callable[[DataFrame], DataFrame], fits: str) -> DataFrame:
    """(id, component) over the verified links among ids that share a key; ids without a link have no row.

    members has (key, id), distinct; verify takes candidate pairs (a, b) with a < b and returns those that are
    links. A key with two members is their pair. Larger groups are not expanded into all their pairs: first
    every key compares its members with one leader, the most central member (by central(ids): id, central), of
    equals the one that lies in the largest keys: in a group of edited copies the original is such a hub. Then
    keys whose members still lie in different components do so with a leader from outside the first leader's
    component. For what is still apart, finer(ids) has rows (key, id, more) such that every link shares a key
    at which `fits` holds (the other row's columns have a 2 behind their names); it is compared exactly, across
    components only. So no link between two components is lost, and links inside one are never needed.
    """
    # what is summed by key is written before it is joined: a hot key's rows can then be split among tasks
    shared = scratch.table(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    held = scratch.table(members.join(shared, "key").select("key", "id", "n"), "shared")
    rank = held.groupBy("id").agg(F.sum(F.when(F.col("n") > 2, F.col("n"))).alias("hub")).where("hub IS NOT NULL")
    couples = held.where("n = 2").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b").distinct()
    held = scratch.table(held.where("n > 2").select("key", "id").join(rank, "id"), "hubs")
    middle = central(held.select("id").distinct()) if central else held.select("id", F.lit(0).alias("central")).distinct()
    held = scratch.table(held.join(middle, "id"), "members")
    leader = F.max(F.struct("central", "hub", (-F.col("id")).alias("neg"), F.col("c").alias("lc"))).alias("top")
    labels = tried = None
    for stage in ("leader", "second leader", "rest"):
        now = held.withColumn("c", F.col("id")) if labels is None else held.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        split = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), leader).where("c0 < c1")
        if stage == "second leader":
            split = scratch.table(split, "split")
            others = scratch.table(now.join(split.select("key", F.col("top.lc").alias("first")), "key").where("c <> first"), "others")
            split = others.groupBy("key").agg(leader)
        split = scratch.table(split.select("key", *(["top"] if stage != "rest" else [])), f"keys of {stage}")
        if stage != "rest":
            pairs = now.join(split.select("key", "top"), "key").where("c <> top.lc").select("id", (-F.col("top.neg")).alias("id2"))
        else:
            rest = scratch.table(now.join(split.select("key"), "key").select("id", "c").distinct(), "rest")
            fine = scratch.table(finer(rest.select("id")).join(rest, "id"), "finer")
            other = fine.select("key", *(F.col(c).alias(f"{c}2") for c in fine.columns if c != "key"))
            pairs = fine.join(other, "key").where(f"c <> c2 AND id < id2 AND {fits}")
        pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        if stage == "leader":
            pairs = pairs.union(couples)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        asked = scratch.table(pairs, f"pairs of {stage}")
        if not asked.limit(1).count():
            continue
        found = scratch.table(verify(asked).select("a", "b"), f"links of {stage}")
        tried = asked if tried is None else tried.union(asked)
        if found.limit(1).count():
            labels = components(found, scratch, f"components by {stage}") if labels is None else merged(labels, found, scratch, f"components by {stage}")
    scratch.drop("keys", "shared", "split", "hubs", "members", "others", "rest", "finer")
    return labels if labels is not None else scratch.spark.createDataFrame([], "id long, component long")
