"""Runs of words that two tables share, found by rolling hashes and joined as words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import WORD
from ..session import spread

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Distinct hashes that every worker may hold (8 bytes each).
MOST_HELD = 4_000_000
#: Texts whose words and runs a worker holds at a time.
_ROWS = 256


def word_runs(rows: DataFrame, n: int, held: np.ndarray | None = None) -> DataFrame:
    """(columns of rows but text, run, hash): the distinct runs of n words of each lower-cased text, words joined by spaces.

    held: sorted hashes; runs with other ones are left out where they are made, and no string is built for them. Hashes are of
    64 bits and only leave out: what is joined on are the words. Null texts and texts of fewer words have no run.
    """
    keep = [c for c in rows.columns if c != "text"]
    words = spread(rows).select(*keep, F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 1).alias("words")).where(F.size("words") >= n)
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for whole_batch in batches:
            for lo in range(0, len(whole_batch), _ROWS):
                batch = whole_batch.slice(lo, _ROWS)
                lists = batch.column(len(keep))
                flat, counts = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
                names = flat.dictionary.to_pylist()
                h = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))[flat.indices.to_numpy()]
                row = np.repeat(np.arange(len(counts)), counts)
                m = len(h) - n + 1
                run = np.zeros(max(m, 0), np.uint64)
                for k, power in enumerate(np.multiply.accumulate(np.full(n, _STEP))):
                    run += h[k : k + m] * power
                whole = row[:m] == row[n - 1 :]
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, run), max(len(wanted) - 1, 0))
                    whole &= wanted[at] == run if len(wanted) else False
                place = np.flatnonzero(whole)
                code = flat.indices.to_numpy()
                texts = [" ".join(names[c] for c in code[p : p + n]) for p in place.tolist()]
                take = pa.array(row[place])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(len(keep))), pa.array(texts, pa.string()), pa.array(run[place].view(np.int64))], [*keep, "run", "hash"])

    schema = StructType([*words.select(*keep).schema.fields, StructField("run", StringType()), StructField("hash", LongType())])
    return words.mapInArrow(cut, schema).distinct()


def held_hashes(runs: DataFrame, most: int = MOST_HELD) -> np.ndarray | None:
    """The sorted distinct hashes, or None if there are more than `most`: the join then does the whole work."""
    distinct = runs.select("hash").distinct()
    if distinct.limit(most + 1).count() > most:
        return None
    return np.sort(distinct.toArrow().column("hash").to_numpy().view(np.uint64))
