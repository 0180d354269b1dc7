"""Digests of tables that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A digest is four sums modulo 2**32 of eight hex digits each.
CHUNKS = 4


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the values as text, each with its length before it (null: -), so that no two rows read alike."""
    parts = []
    for c in columns:
        x = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def summed(h: Column) -> Column:
    """128 bits as 32 hex digits: the sums of the parts of all hashes. A row twice is not the same as none."""
    chunk = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    total = lambda k: (F.coalesce(F.sum(chunk(k)), F.lit(0).cast("decimal(20,0)")) % F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
    return F.concat(*(F.lower(F.lpad(F.hex(total(k)), 8, "0")) for k in range(CHUNKS)))


def table_digest(rows: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(by, rows, digest) over columns (all, by name): equal for equal multisets of rows in any order and partitioning.

    Sums are partial aggregates, so that nothing but one row a group and task is shuffled. An empty table has digest 0.
    """
    hashed = rows.select(*(by or []), row_hash(columns or sorted(rows.columns)).alias("__h"))
    return hashed.groupBy(*(by or [])).agg(F.count("*").alias("rows"), summed(F.col("__h")).alias("digest"))
