"""A recipe that is frozen before the final table is opened: digests of its tables, its limits, and what may not change after."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .digests import table_digest

RECIPE = "kind string, name string, value string, rows long"


def recipe(tables: dict[str, DataFrame], limits: dict[str, object]) -> DataFrame:
    """(kind, name, value, rows): a digest for each table, a text for each limit. Digests are computed where the rows are."""
    if not tables:
        raise ValueError("a recipe binds at least one table")
    out = None
    for name, rows in sorted(tables.items()):
        one = table_digest(rows).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), F.col("digest").alias("value"), "rows")
        out = one if out is None else out.union(one)
    bound = [("limit", k, str(v), None) for k, v in sorted(limits.items())]
    return out.union(out.sparkSession.createDataFrame(bound, RECIPE)) if bound else out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Names that the two recipes bind differently; recipes have a row a table or limit."""
    left, right = ({(r["kind"], r["name"]): (r["value"], r["rows"]) for r in x.collect()} for x in (a, b))
    return sorted(f"{k[0]} {k[1]}" for k in left.keys() | right.keys() if left.get(k) != right.get(k))


def freeze(spark: SparkSession, folder: str, tables: dict[str, DataFrame], limits: dict[str, object], rationale: str) -> str:
    """Writes the recipe, and returns `frozen`; `reused` if the same one is there already.

    Refused (ValueError): another recipe where one is frozen, any selection after the final table was opened, and a
    selection without a rationale. The recipe is written beside and renamed, so that a lost driver leaves none or a whole one.
    """
    if not rationale.strip():
        raise ValueError("a selection needs its rationale")
    if _exists(spark, f"{folder}/opened"):
        raise ValueError("the final table has been opened: nothing is selected any more")
    made = recipe(tables, {**limits, "rationale": rationale})
    if _exists(spark, f"{folder}/recipe"):
        changed = _differences(spark.read.schema(RECIPE).parquet(f"{folder}/recipe"), made)
        if changed:
            raise ValueError(f"another recipe is frozen: {', '.join(changed)}")
        return "reused"
    beside = f"{folder}/recipe-{uuid.uuid4().hex}"
    made.coalesce(1).write.parquet(beside)  # a row a table or limit
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(path(beside), path(f"{folder}/recipe")):
        raise ValueError("another recipe was frozen meanwhile")
    return "frozen"


def validate(spark: SparkSession, folder: str, tables: dict[str, DataFrame], limits: dict[str, object]) -> DataFrame:
    """The frozen recipe; ValueError if a table or a limit is not the one that was frozen."""
    if not _exists(spark, f"{folder}/recipe"):
        raise ValueError("no recipe is frozen")
    held = spark.read.schema(RECIPE).parquet(f"{folder}/recipe")
    changed = _differences(held.where("name <> 'rationale'"), recipe(tables, limits))
    if changed:
        raise ValueError(f"changed since it was frozen: {', '.join(changed)}")
    return held


def open_final(spark: SparkSession, folder: str, tables: dict[str, DataFrame], limits: dict[str, object]) -> DataFrame:
    """Validates, and leaves the marker after which nothing is selected; opening again is allowed, with the same recipe only."""
    held = validate(spark, folder, tables, limits)
    if not _exists(spark, f"{folder}/opened"):
        held.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "kind", "name", "value"))), "\n"), 256).alias("recipe")).coalesce(1).write.parquet(f"{folder}/opened")
    return held
