"""Operator 8: benchmark decontamination by greedy string tiling, which also finds passages in another order."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BASE, INVERSE, U64, Scratch, mix64, powers, signed

#: Words of a seed, which is also the least tile; share of an item's words that tiles must cover; words of the shortest
#: item that is searched for (fewer words are in too many texts to say anything).
SEED, COVERAGE, SHORTEST = 5, 0.8, 3
#: Distinct seeds that every worker holds as a filter (8 bytes each); with more, documents meet seeds by a shuffle.
HELD_SEEDS = 4_000_000
#: Into how many rows a document's items are dealt at most.
GROUPS = 16
#: Scripts that put no space between words: each of their characters counts as a word.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each code point: 0 if it separates words, 1 if it is part of one, 2 if it is one; and its hash."""
    if not _TABLES:
        kind = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
        for lo, hi in _UNSPACED:
            kind[lo : hi + 1] *= 2
        _TABLES.extend([kind, mix64(np.arange(1, len(kind) + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95))])
    return _TABLES


def folded(text: str | None) -> str:
    """Compatibility forms and case folded: the one form in which items and documents are compared."""
    text = text or ""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many words lie before each text."""
    kind, codes = _tables()
    parts = [folded(t) for t in texts]
    c = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kind[c]
    before = np.concatenate([[0], k[:-1]])
    after = np.concatenate([k[1:], [0]])
    start = np.flatnonzero((k == 2) | (k == 1) & (before != 1))
    stop = np.flatnonzero((k == 2) | (k == 1) & (after != 1)) + 1
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(codes[c] * powers(BASE, len(c)), out=sums[1:])
    words = mix64((sums[stop] - sums[start]) * powers(INVERSE, len(c) + 1)[start] + (stop - start).astype(np.uint64) * U64(0xA0761D6478BD642F))
    return words, np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in parts)]))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `width` words, from running sums."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    n = len(words) - width + 1
    return mix64((sums[width:] - sums[:n]) * powers(INVERSE, n) + U64(width))


def _sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=out[1:])
    return out


def _scan(doc: np.ndarray, item: np.ndarray, used_doc: np.ndarray, used_item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(-words, place in doc, place in item) of the longest unmarked matches on each diagonal, of `width` words at least.

    Only the first place of each match is made: two places of one hash whose words before are equal, and free, lie inside
    a match that begins earlier. A word that goes on for thousands of places has a match for each diagonal, not for each
    pair. Lengths are found by halving, over hashes of what follows.
    """
    # marked words equal nothing: those of doc and item differ from all words and from each other
    marks = np.arange(len(doc) + len(item) + 2, dtype=np.uint64)
    d = np.where(used_doc, mix64(marks[: len(doc)] ^ U64(0xA5A5)), doc)
    m = np.where(used_item, mix64(marks[len(doc) : len(doc) + len(item)] ^ U64(0xA5A5)), item)

    def free(used: np.ndarray) -> np.ndarray:
        marked = np.concatenate([[0], np.cumsum(used)])
        return np.flatnonzero(marked[width:] == marked[:-width])

    p, q = free(used_doc), free(used_item)
    if not len(p) or not len(q):
        return []
    hp, hq = rolling(d, width)[p], rolling(m, width)[q]
    before_d, before_m = np.append(mix64(marks[-2:-1]), d[:-1])[p], np.append(mix64(marks[-1:]), m[:-1])[q]
    # the item's places by hash, then by the word before: those of one hash and another word before are two stretches
    _, kind = np.unique(np.concatenate([hq, hp]), return_inverse=True)
    _, word = np.unique(np.concatenate([before_m, before_d]), return_inverse=True)
    n_words = int(word.max()) + 1
    key = kind[: len(q)].astype(np.int64) * n_words + word[: len(q)]
    order = np.argsort(key, kind="stable")
    key, q = key[order], q[order]
    group, own = kind[len(q) :].astype(np.int64) * n_words, word[len(q) :]
    lo, hi = np.searchsorted(key, group), np.searchsorted(key, group + n_words)
    same_lo, same_hi = np.searchsorted(key, group + own), np.searchsorted(key, group + own, "right")
    starts = np.concatenate([p, p])
    from_, to = np.concatenate([lo, same_hi]), np.concatenate([same_lo, hi])
    n = to - from_
    ps = np.repeat(starts, n)
    qs = q[np.repeat(from_, n) + np.arange(len(ps)) - np.repeat(np.cumsum(n) - n, n)]
    # the longest common stretch from each pair: by halving, as hashes of equal stretches are equal
    sd, sm = _sums(d), _sums(m)
    inverse = powers(INVERSE, max(len(sd), len(sm)))
    good = np.full(len(ps), width)
    bad = np.minimum(len(d) - ps, len(m) - qs) + 1
    while (open_ := bad - good > 1).any():
        half = np.where(open_, (good + bad) // 2, good)
        equal = (sd[ps + half] - sd[ps]) * inverse[ps] == (sm[qs + half] - sm[qs]) * inverse[qs]
        good, bad = np.where(open_ & equal, half, good), np.where(open_ & ~equal, half, bad)
    return list(zip((-good).tolist(), ps.tolist(), qs.tolist()))


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, words) of non-overlapping tiles, longest first.

    Running Karp-Rabin: runs of a search length are hashed in what is not marked yet, equal ones are extended, and the
    longest matches are marked (of equals the earlier place in doc, then in item); the search length falls by half
    until it is `least`. A match that lost words to another goes on with the rest of it.
    """
    least = min(least, len(item))
    tiles: list[tuple[int, int, int]] = []
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    width = len(item)
    while least and len(doc) >= least:
        if width <= len(doc):
            queue = _scan(doc, item, used_doc, used_item, width)
            heapq.heapify(queue)
            while queue and not used_item.all():
                n, p, q = heapq.heappop(queue)
                taken = used_doc[p : p - n] | used_item[q : q - n]
                if not taken.any():
                    if not (doc[p : p - n] == item[q : q - n]).all():
                        raise ArithmeticError("words of one hash differ")  # 64 bits did not tell two stretches apart
                    tiles.append((p, q, -n))
                    used_doc[p : p - n] = used_item[q : q - n] = True
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if b - a >= width:
                        heapq.heappush(queue, (a - b, p + a, q + a))
        if width == least:
            break
        width = max(least, width // 2)
    return tiles


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `most` characters; a longer text is a run of its own."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= most):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column(1).to_pylist(), [[], [], [], []]
        for lo, hi in _slices(texts):
            words, at = tokens(texts[lo:hi])
            for k in range(hi - lo):
                n = int(at[k + 1] - at[k])
                if n >= SHORTEST:
                    h = rolling(words[at[k] : at[k + 1]], min(SEED, n))
                    for column, values in zip(out, (np.full(len(h), lo + k), h.view(np.int64), np.full(len(h), min(SEED, n)), np.full(len(h), n))):
                        column.append(values)
        if out[0]:
            row, seed, width, n = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(seed), pa.array(width.astype(np.int32)), pa.array(n.astype(np.int32))], ["item", "seed", "width", "n"])


def _own(docs: DataFrame) -> DataFrame:
    """(d, k) stands for the doc_id and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), "text")


def document_seeds(docs: DataFrame, widths: list[int], held: np.ndarray | None) -> DataFrame:
    """(d, k, seed): the distinct seeds of each document, of those in `held` (sorted) if it is given."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in _slices(texts):
                words, at = tokens(texts[lo:hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                rows, seeds = [], []
                for width in widths:
                    h = rolling(words, width)
                    inside = doc[: len(h)] == doc[width - 1 :]
                    if wanted is not None and len(wanted):
                        inside &= wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    rows.append(doc[: len(h)][inside])
                    seeds.append(h[inside])
                row, seed = np.concatenate(rows), np.concatenate(seeds)
                order = np.lexsort((seed, row))
                row, seed = row[order], seed[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
                if new.any():
                    take = pa.array(row[new] + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), signed(seed[new])], ["d", "k", "seed"])

    return _own(docs).mapInArrow(find, "d long, k long, seed long")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, held_seeds: int = HELD_SEEDS) -> DataFrame:
    """(doc_id, k, item_id, coverage, n_tiles, n_words): as `contaminated`, with the text's xxhash64 as k."""
    spark = docs.sparkSession
    schema = "doc_id long, k long, item_id long, coverage double, n_tiles long, n_words long"
    scratch = Scratch(spark, "leaks")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("passage")).distinct()
    items = scratch.table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = scratch.table(items.select("item", "passage").mapInArrow(_item_seeds, "item long, seed long, width int, n int").groupBy("item", "seed", "width", "n").agg(F.count("*").alias("times")), "seeds")
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # at most three values
    if not widths:
        return spark.createDataFrame([], schema)
    distinct = seeds.select("seed").distinct()
    held = None
    if distinct.limit(held_seeds + 1).count() <= held_seeds:
        held = np.sort(distinct.toArrow().column("seed").to_numpy().view(np.uint64))
    # documents by what they share with any item; where not all seeds are held, the join leaves the others out
    found = document_seeds(docs, widths, held).distinct()
    found = scratch.table(found if held is not None else found.join(distinct, "seed", "left_semi").select("d", "k", "seed"), "found")
    often = scratch.table(found.groupBy("seed").agg(F.count("*").alias("df")), "often")
    # an item's hits are at least `need`: its commonest seeds that together have fewer are not enough, so that one of the others is hit
    need = F.ceil(F.lit(coverage) * F.col("n") / F.col("width"))
    commoner = W.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)).desc(), "seed").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = seeds.join(often, "seed", "left").withColumn("reach", F.sum("times").over(commoner)).withColumn("need", need)
    rare = scratch.table(ranked.where("reach >= need AND df > 0").select("item", "seed"), "rare")
    met = scratch.table(found.join(rare, "seed").select("d", "k", "item").distinct(), "met")
    rows = met.select(F.col("d").alias("md"), F.col("k").alias("mk"), "item").join(seeds, "item")
    hits = rows.join(found, rows["md"].eqNullSafe(found["d"]) & (rows["mk"] == found["k"]) & (rows["seed"] == found["seed"])).groupBy("d", "k", "item", "width", "n").agg(F.sum("times").alias("hits"))
    pairs = hits.where(F.col("hits") * F.col("width") >= F.lit(coverage) * F.col("n")).select("d", "k", "item").join(items, "item")
    # a document's items come together, so that it is cut into words once for each GROUPS-th of all items
    grouped = pairs.groupBy(F.col("d").alias("pd"), F.col("k").alias("pk"), F.pmod("item_id", F.lit(GROUPS))).agg(F.collect_list(F.struct("item_id", "passage")).alias("items"))
    grouped = scratch.table(grouped.select("pd", "pk", "items"), "pairs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, k, text, wanted in zip(*(batch.column(c) for c in range(4))):
                wanted = wanted.as_py()
                words, at = tokens([text.as_py(), *(w["passage"] for w in wanted)])
                for w, lo, hi in zip(wanted, at[1:-1], at[2:]):
                    tiles = tile(words[: at[1]], words[lo:hi])
                    covered = sum(n for _, _, n in tiles)
                    if tiles and covered >= coverage * (hi - lo):
                        out.append((d.as_py(), k.as_py(), w["item_id"], covered / int(hi - lo), len(tiles), covered))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "k", "item_id", "coverage", "n_tiles", "n_words"])

    text = _own(docs)
    both = text.join(grouped, text["d"].eqNullSafe(grouped["pd"]) & (text["k"] == grouped["pk"]))
    return both.select("d", "k", "text", "items").mapInArrow(search, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, held_seeds: int = HELD_SEEDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words) of documents whose tiles cover enough of a benchmark item.

    Words are runs of letters, marks and digits of the folded text (compatibility forms, case), so that punctuation, quotes
    and white space don't hide a passage; in scripts without spaces each character is a word.

    1. The seeds of the items, runs of 5 words (of all words, if an item has fewer), are joined to those of the documents.
       Where the items have few enough distinct ones, every worker holds these and leaves others out before the join.
       An item is joined by its rarest seeds, of which a document must have one: a phrase that many items and documents
       share makes no pairs. Seeds are counted for the pairs that met.
    2. A document and an item whose shared seeds can cover enough of the item are tiled.

    The documents are read once for the seeds and once for the texts to be tiled, whatever the number of items. Null and
    empty texts match nothing; items of fewer than 3 words and rows with a null item_id are left out; a null doc_id
    stays null in the result. Repeated documents each give their rows, repeated items one. Other columns are ignored.
    """
    return leaks(docs, benchmark, coverage, held_seeds).drop("k")
