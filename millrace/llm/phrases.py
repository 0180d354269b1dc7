"""Operator 11: phrases of two to four words that occur together more often than their parts would have them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import _LOWER, U64, Scratch, mix64, prefix_hash, range_hash, text_slices, words

#: Words of a phrase at most: the depth of the tries.
DEPTH = 4
#: Bits of the filter that a shard asks before it grows a path: 8 MB for each worker, whatever the input. As it fills, more
#: paths grow than need to; what they count to is decided after the merge, exactly.
FILTER_BITS = 1 << 26
#: Bytes of text that make a shard; a longer text is a shard of its own.
SHARD = 1 << 22
#: Parts that a language's candidates are ranked in before the whole language is.
PARTS = 64

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_STEP = U64(0x9FB21C651E98DF25)


def _hashed(lang: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, apart by language (lang: a hash for each word)."""
    return mix64(range_hash(prefix_hash(data), starts, ends) + lang)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _STEP + b)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h & U64(FILTER_BITS - 1)) >> U64(6)] >> (h & U64(63)) & U64(1)).astype(bool)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> pa.Array:
    """Some of the byte ranges, which follow each other, as strings."""
    offsets = np.stack([starts, ends], 1).ravel().astype(np.int64)
    both = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return both.take(pa.array(2 * which))


def shard_tries(docs: DataFrame, depths: tuple[int, ...], allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(lang, phrase, n): the nodes at these depths of a count trie of each shard, in the order of the trie.

    A trie's children are numbered in word order under their parent, so that its nodes come out sorted. A path grows by
    a word if the same piece goes on with it and allowed(hashes of words, steps to the next word) lets it.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang_hash = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, data, offsets in text_slices(batch, "text", SHARD):
                low = _LOWER[data]
                starts, ends, at = words(low, offsets, _BLANK | _BREAK)
                if not len(starts):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                h = _hashed(lang_hash[lo:hi][doc], low, starts, ends)
                breaks = np.concatenate([[0], np.cumsum(_BREAK[low])])[starts]
                steps = np.append((breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1]), False)
                _, first, kind = np.unique(h, return_index=True, return_inverse=True)
                own = pa.table({"lang": langs.slice(lo, hi - lo).take(pa.array(doc[first])), "word": _strings(low, starts, ends, first)})
                order = pc.sort_indices(own, [("lang", "ascending"), ("word", "ascending")]).to_numpy()
                own = own.take(pa.array(order))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                word = rank[kind]
                if 1 in depths:
                    yield _rows(own["lang"], own["word"], np.bincount(word, minlength=len(own)))
                if max(depths) == 1:
                    continue
                steps &= allowed(h, steps)
                place, node = np.arange(len(word)), word
                for depth in range(2, max(depths) + 1):
                    grows = steps[place + depth - 2]
                    place, node = place[grows], node[grows]
                    _, first, node, n = np.unique(node * len(own) + word[place + depth - 1], return_index=True, return_inverse=True, return_counts=True)
                    if depth in depths and len(n):
                        path = [word[place[first] + k] for k in range(depth)]
                        phrase = pc.binary_join_element_wise(*(own["word"].take(pa.array(p)) for p in path), pa.scalar(" ", pa.large_string()))
                        yield _rows(own["lang"].take(pa.array(path[0])), phrase, n)

    return _texts(docs).mapInArrow(build, "lang string, phrase string, n long")


def _rows(lang, phrase, n: np.ndarray) -> pa.RecordBatch:
    whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.RecordBatch.from_arrays([whole(lang).cast(pa.string()), whole(phrase).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.where("text IS NOT NULL").select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), "text")


def merged_tries(tries: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that occur `least` times in all shards.

    Each range of prefixes gets its sorted stretch of every shard's trie and merges them. Ranges are cut anywhere in a
    subtree, and a phrase has a row a shard at most, so that a hot first word fills no task.
    """
    return tries.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_filter(phrases: DataFrame) -> np.ndarray:
    """Bits of the hashes of phrases of one or two words, FILTER_BITS in all."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "phrase"):
                starts, ends, at = words(data, offsets, _BLANK)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                lang = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).view(np.uint64)
                h = _hashed(lang[doc], data, starts, ends)
                one = np.diff(at) == 1
                first = at[:-1]
                h = np.where(one, h[first], _paired(h[first], h[np.minimum(first + 1, len(h) - 1)])) & U64(FILTER_BITS - 1)
                yield pa.RecordBatch.from_pydict({"slot": pa.array((h >> U64(6)).astype(np.int64)), "bit": pa.array((U64(1) << (h & U64(63))).view(np.int64))})

    hashed = phrases.select(F.xxhash64("lang").alias("lang_hash"), "phrase").mapInArrow(hashes, "slot long, bit long")
    slots = hashed.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return bits


def left_parts(tries: DataFrame) -> DataFrame:
    """(lang, phrase, a, l): the counts of the first 1, 2, ... words of each longer phrase, by a walk over the sorted trie.

    Where a range begins inside a subtree, counts of what lies before it are null: at most DEPTH - 1 prefixes a range.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at = [], None  # what is a prefix of the phrase just read, as (phrase, count)
        for batch in batches:
            rows = []
            for lang, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
                if lang != at:
                    path, at = [], lang
                while path and not phrase.startswith(path[-1][0]):
                    path.pop()
                if " " in phrase:
                    held, cuts = dict(path), [k for k, c in enumerate(phrase) if c == " "]
                    rows.append((lang, phrase, n, [held.get(phrase[:k]) for k in cuts]))
                path.append((phrase, n))
            if rows:
                lang, phrase, n, left = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64()), pa.array(left, pa.list_(pa.int64()))], ["lang", "phrase", "a", "l"])

    return tries.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase").select("lang", "phrase", "n").mapInArrow(walk, "lang string, phrase string, a long, l array<long>")


def _first(k: Column | str) -> Column:
    return F.substring_index("phrase", " ", k)


def _filled(walked: DataFrame, tries: DataFrame) -> DataFrame:
    """`walked` with the counts that its ranges lacked: a few a range, so they may be broadcast."""
    lacking = walked.where("exists(l, x -> x IS NULL)").select("lang", "phrase", F.posexplode("l").alias("k", "held")).where("held IS NULL")
    lacking = lacking.select("lang", F.expr("substring_index(phrase, ' ', k + 1)").alias("phrase")).distinct()
    found = tries.join(F.broadcast(lacking), ["lang", "phrase"]).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "n"))).alias("counts"))
    cut = F.expr("transform(l, (x, i) -> coalesce(x, counts[substring_index(phrase, ' ', i + 1)]))")
    return walked.join(F.broadcast(found), "lang", "left").select("lang", "phrase", "a", cut.alias("l"))


def right_parts(left: DataFrame, tries: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, phrase, a, l, r): the counts of the last d - 1, d - 2, ... words.

    A phrase's suffix link leads to the phrase without its first word, which holds the counts of all shorter ends.
    """
    known = tries.where("instr(phrase, ' ') = 0").select("lang", "phrase", F.array("n").alias("ends"))
    out = None
    for depth in range(2, DEPTH + 1):
        own = left.where(f"size(l) = {depth - 1}").withColumn("link", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
        linked = own.join(known.select("lang", F.col("phrase").alias("link"), F.col("ends").alias("r")), ["lang", "link"]).select("lang", "phrase", "a", "l", "r")
        linked = scratch.table(linked, f"links-{depth}")
        known = linked.select("lang", "phrase", F.concat(F.array("a"), "r").alias("ends"))
        out = linked if out is None else out.union(linked)
    return out


def scored(parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the lowest-scoring cut, ties to the earliest; exact beyond 64 bits."""
    cut = "transform(l, (x, i) -> named_struct('score', (2000000 * CAST(a AS DECIMAL(20, 0))) DIV (CAST(x AS DECIMAL(20, 0)) + r[i]), 'k', i, 'l', x, 'r', r[i]))"
    return parts.withColumn("cut", F.array_min(F.expr(cut))).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def without_parts(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates without those that lie in a longer candidate (dropped or not) which has `percent` of their count."""
    inner = F.expr("""flatten(transform(sequence(2, size(words) - 1), d -> transform(sequence(1, size(words) - d + 1), k -> array_join(slice(words, k, d), ' '))))""")
    longer = candidates.withColumn("words", F.split("phrase", " ", -1)).where("size(words) > 2")
    most = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent)
    return candidates.join(most, ["lang", "phrase"], "left").where(kept).drop("longer")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each lang; ranked in PARTS parts first, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each lang (null: und).

    Three passes over all texts, each a set of shard tries that are merged by prefix range: words; pairs of frequent
    words; three and four words whose pairs are all frequent. A phrase that occurs `least` times has parts that do, so
    that nothing is lost by growing only frequent paths.

    Words of equal hash (64 bits) in one shard would be counted as one; strings are compared everywhere else.
    Null, empty and blank texts have no words; a lang of such texts alone has no rows. A lang with no candidate has none
    either. Repeated rows count as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    runs = scratch.table(shard_tries(docs, (1,), lambda h, steps: steps), "runs-1")
    total = scratch.table(runs.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    levels = [scratch.table(merged_tries(runs, least), "level-1")]
    held = spark.sparkContext.broadcast(frequent_filter(levels[0]))
    scratch.drop("runs-1")

    def frequent_words(h: np.ndarray, steps: np.ndarray) -> np.ndarray:
        common = _in(held.value, h)
        return common & np.append(common[1:], False)

    levels.append(scratch.table(merged_tries(scratch.table(shard_tries(docs, (2,), frequent_words), "runs-2"), least), "level-2"))
    scratch.drop("runs-2")
    pairs = spark.sparkContext.broadcast(frequent_filter(levels[1]))

    def frequent_pairs(h: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return np.append(_in(pairs.value, _paired(h[:-1], h[1:])), False)

    levels.append(scratch.table(merged_tries(scratch.table(shard_tries(docs, tuple(range(3, DEPTH + 1)), frequent_pairs), "runs-3"), least), "level-3"))
    scratch.drop("runs-3")
    tries = levels[0].union(levels[1]).union(levels[2])
    walked = scratch.table(left_parts(tries), "walked")
    candidates = scratch.table(scored(right_parts(_filled(walked, tries), tries, scratch)), "candidates")
    best = ranked(without_parts(candidates, percent), top).join(total.withColumnRenamed("total", "n"), "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
