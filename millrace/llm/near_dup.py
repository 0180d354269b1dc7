"""Operator 5: near duplicates by min-max hashing of word shingles, with links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import U64, Scratch, linked, merged, mix64, shingle_hashes, signed, text_slices

#: 32 permutations give 64 values (a minimum and a maximum each): 16 bands of 4. Two sets of similarity s meet in a
#: band with probability 1 - (1 - s**4)**16: 0.99999 at 0.85, 0.9998 at 0.8.
PERMUTATIONS, ROWS = 32, 4
_ODD = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def min_max(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets x 2 PERMUTATIONS): the minima and then the maxima of each set under each permutation.

    h: the sets' hashes, concatenated; starts: where each set begins (no set is empty). One multiplication by
    an odd number permutes the hashes, and both ends of the order are kept.
    """
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k, odd in enumerate(_ODD):
        x = h * odd
        out[:, k] = np.minimum.reduceat(x, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(x, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(sets x bands) 64-bit keys; each band's key holds the band's number."""
    bands = values.reshape(len(values), -1, ROWS)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        key = mix64(key * U64(0xD6E8FEB86659FD93) + bands[:, :, k])
    return key


def _distinct(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, concatenated, and where each begins."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(before)))


def _own(docs: DataFrame) -> DataFrame:
    """(doc_id, k) stands for the doc_id and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, k, n_shingles, d1, d2, keys): the set's size, a 128-bit digest of it, and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = 2 * PERMUTATIONS // ROWS
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "text"):
                h, at = _distinct(*shingle_hashes(data, offsets, width))
                n = np.diff(at)
                some = n > 0
                keys, d1, d2 = np.zeros((hi - lo, bands), np.uint64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if some.any():
                    starts = at[:-1][some]
                    keys[some] = band_keys(min_max(h, starts))
                    d1[some] = np.add.reduceat(mix64(h + U64(1)), starts)
                    d2[some] = np.bitwise_xor.reduceat(mix64(h + U64(2)), starts)
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), signed(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(2)), pa.array(n.astype(np.int64)), signed(d1), signed(d2), held], ["doc_id", "k", "n_shingles", "d1", "d2", "keys"])

    return _own(docs).mapInArrow(sign, "doc_id long, k long, n_shingles long, d1 long, d2 long, keys array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, shingles) from (id, text): the full sets as sorted hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "text"):
                h, at = _distinct(*shingle_hashes(data, offsets, width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), signed(h))], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(build, "id long, shingles array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the documents that wanted (id, w, wk: doc_id and k) names, once each.

    Texts pass a bitmap of 2**24 hashed documents before they are shuffled: at most 2**18 rows of 64 bits, whatever
    the input, so they may be broadcast. It only lets more pass as it fills; the join decides.
    """
    word, bit = "shiftrightunsigned(h, 6) & 262143", "shiftleft(1L, cast(h & 63 AS int))"
    marks = wanted.select(F.xxhash64("w", "wk").alias("h")).groupBy(F.expr(word).alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    own = _own(docs).withColumn("h", F.xxhash64("doc_id", "k")).withColumn("word", F.expr(word))
    passed = own.join(F.broadcast(marks), "word").where(f"(bits & {bit}) <> 0").select("doc_id", "k", "text")
    found = passed.join(wanted, (F.col("doc_id") == F.col("w")) & (F.col("k") == F.col("wk")))
    # rows alike in doc_id and text meet where the join has put them: no set is shuffled
    return found.dropDuplicates(["doc_id", "k", "id"]).select("id", "text")


def linked_classes(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, k, n_shingles, id) of all documents, and links (id, component) of the classes that have any.

    1. Documents with equal sets are one class, by a 128-bit digest; id is its number (null without shingles or doc_id),
       and one of its documents represents it.
    2. Representatives that share a band are candidates; `linked` picks which pairs to compare, so that a group
       of near copies is never expanded into all its pairs.
    3. Sets are built again from the texts of the representatives that share a band with another, once, and
       every link is confirmed on them.
    """
    signed_docs = scratch.table(signatures(docs, width), "signatures")
    named = "n_shingles > 0 AND doc_id IS NOT NULL"
    classes = signed_docs.where(named).groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "k")).alias("of"), F.first("keys").alias("keys"))
    classes = scratch.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode("keys").alias("key"), "id")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = members.join(shared, "key", "left_semi").select("id").distinct().join(classes, "id").select("id", F.col("of.doc_id").alias("w"), F.col("of.k").alias("wk"))
    # written, so that its size is known: where it is small, the texts need not be shuffled
    wanted = scratch.table(wanted, "wanted")
    sets = scratch.table(shingle_sets(_texts_of(docs, wanted), width), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.where(f"100L * least(size(sa), size(sb)) >= {percent} * greatest(size(sa), size(sb))")
        both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return both.where(f"100L * common >= {percent} * (na + nb - common)").select("a", "b")

    def exploded(ids: DataFrame) -> DataFrame:
        return sets.join(ids, "id").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))

    def central(ids: DataFrame) -> DataFrame:
        """The fewer shingles a document has that no other of these has, the more central it is."""
        alone = exploded(ids).groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
        return ids.join(alone, "id", "left").select("id", (-F.coalesce("u", F.lit(0))).alias("central"))

    def prefixes(ids: DataFrame) -> DataFrame:
        """The rarest shingles of each set, as many as one of them must be shared by every link, with their places."""
        rare = exploded(ids).join(exploded(ids).groupBy("key").agg(F.count("*").alias("df")), "key")
        rare = rare.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("df", "key")) - 1)
        return rare.where(f"place <= floor(n * {100 - percent} / 100)").select("key", "id", "n", "place")

    # the first shared shingle's places bound the intersection by what comes after them
    fits = f"{100 + percent} * least(n - place, n2 - place2) >= {percent} * (n + n2)"
    labels = linked(members, confirm, scratch, central, prefixes, fits)
    scratch.drop("sets", "wanted")
    # documents without shingles meet no class: they are kept out of the join
    of_class = signed_docs.where(named).join(classes.select("d1", "d2", "n_shingles", "id"), ["d1", "d2", "n_shingles"]).select("doc_id", "k", "n_shingles", "id")
    rest = signed_docs.where(f"NOT ({named})").select("doc_id", "k", "n_shingles", F.lit(None).cast("long").alias("id"))
    rows = scratch.table(of_class.union(rest), "rows")
    scratch.drop("signatures", "classes")
    return rows, labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct word shingles;
    component_id is the smallest doc_id reachable, and kept says that it is the document's own.

    Null, empty and blank texts: no shingle, linked with nothing. Fewer words than `width`: the whole sequence
    is one shingle. A null doc_id is linked with nothing: component_id null, kept. Rows of one doc_id are one
    node, whatever their texts: each of them links it. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows, labels = linked_classes(docs, width, percent, scratch)
    # a doc_id with several texts links their classes
    several = rows.where("id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    bridges = scratch.table(rows.join(several, "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct(), "bridges")
    if bridges.limit(1).count():
        labels = merged(labels, bridges, scratch, "bridged")
    placed = rows.join(labels, "id", "left").select("doc_id", "n_shingles", "id", F.coalesce("component", "id").alias("c"))
    least = scratch.table(placed.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    out = placed.where("c IS NOT NULL").join(least, "c").select("doc_id", "n_shingles", "component_id")
    # a blank row of a doc_id that has other texts too belongs with them
    blank = placed.where("c IS NULL").select("doc_id", "n_shingles")
    others = out.join(blank.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("c"))
    ids = blank.where("doc_id IS NOT NULL").join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    out = out.union(ids).union(blank.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def surplus(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, k), k being xxhash64 of the text: the documents that go when one of each group of near copies stays.

    Here a document is a doc_id with a text, so that a doc_id with two texts links nothing and no text is lost without
    a near copy that stays: the one with the smallest doc_id, then the least hash. Rows alike in both are one document.
    Documents without words or doc_id are never surplus. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "surplus")
    rows, labels = linked_classes(docs, width, percent, scratch)
    placed = rows.where("id IS NOT NULL").select("doc_id", "k", "id").distinct().join(labels, "id", "left").select("doc_id", "k", F.coalesce("component", "id").alias("c"))
    # written before the join: a large group's rows can then be split among tasks
    keep = placed.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k")).alias("keep")).where("n > 1")
    keep = scratch.table(keep.select("c", "keep"), "keep")
    return scratch.table(placed.join(keep, "c").where("NOT (doc_id = keep.doc_id AND k = keep.k)").select("doc_id", "k"), "gone")
