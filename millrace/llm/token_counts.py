"""Operator 2: token counts of whole texts, with every distinct pre-token counted once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import Words

#: Pre-tokens that are sent to every worker: at most so many, of so many characters together; a longer one than HEAD_CHARS
#: is left to the join, which splits a key that is too frequent for one task.
HEAD_TYPES, HEAD_SIZE, HEAD_CHARS = 500_000, 24_000_000, 4096


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, head_types: int = HEAD_TYPES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    1. Each distinct pre-token of all texts is counted, and its pieces are counted once.
    2. The most frequent ones (at most head_types) go to every worker; a document's sum over them needs no
       shuffle. All other pre-tokens of a document, with their frequencies, are joined to the table by value.
    Both ways are exact, so the parameter changes the cost only. Texts that the library must take whole (they
    contain special strings or code points unknown here) are counted by it.

    Null and empty text: 0 bytes, 0 tokens. Repeated rows stay. Empty table: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "counts")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words.load(tokenizer), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words.split(text.as_py() or "") or ())
                if len(seen) > 300_000:
                    yield out()
                    seen = Counter()
        yield out()

    def with_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.load(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([words.pieces(w) for w in batch.column(0).to_pylist()], pa.int32())], ["word", "n", "pieces"])

    types = docs.select("text").mapInArrow(occurrences, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    types = scratch.table(types.mapInArrow(with_pieces, "word string, n long, pieces int"), "types")
    # the least frequency (by eighths of its power of two) whose types, with all more frequent ones, are few enough
    short = types.where(F.length("word") <= HEAD_CHARS).withColumn("level", F.floor(F.log2("n") * 8))
    left, room, least = head_types, HEAD_SIZE, None
    for r in short.groupBy("level").agg(F.count("*").alias("types"), F.sum(F.length("word")).alias("size")).orderBy(F.desc("level")).collect():
        left, room = left - r["types"], room - r["size"]
        if left < 0 or room < 0:
            break
        least = r["level"]
    head = {w: p for w, p in short.where(F.col("level") >= least).select("word", "pieces").toArrow().to_pandas().itertuples(index=False)} if least is not None else {}
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words.load(tokenizer), sent.value
        for batch in batches:
            size, count, rest, often = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = words.split(text)
                size.append(len(text) if text.isascii() else len(text.encode("utf-8", "replace")))
                if found is None:
                    count.append(len(words.whole(text)))
                    tail = {}
                else:
                    have = list(map(known.get, found))
                    if None in have:
                        tail = Counter(w for w, p in zip(found, have) if p is None)
                        have = filter(None, have)
                    else:
                        tail = {}
                    count.append(sum(have))
                rest.append(list(tail))
                often.append(list(tail.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(often, pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "head", "rest", "often"],
            )

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_document, "doc_id long, n_bytes long, head long, rest array<string>, often array<int>")
    first = scratch.table(first.withColumn("row", F.monotonically_increasing_id()), "documents")
    tail = first.select("row", F.explode(F.arrays_zip("rest", "often")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.often").alias("k"))
    tail = tail.join(types.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("tail"))
    total = F.col("head") + F.coalesce("tail", F.lit(0))
    return first.select("row", "doc_id", "n_bytes", "head").join(tail, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
