"""Sources with declared schemas and sinks that never leave half a result."""

from __future__ import annotations

import hashlib
import json
import os
import tarfile
import uuid
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranks import placed

DECISION_ROW = (
    "id string, source string, family string, group string, workflow_group string, split string, state string, question string, "
    "candidates array<string>, category string, metric string, evaluation_scope string, target int, target_probs array<double>, "
    "within_pilot_limits boolean, source_partition string, independent_real_prompt boolean, expected_rating double, "
    "rating_attribute string, candidate_values array<double>"
)
MANIFEST = ["id", "group", "workflow_group", "source", "family", "split"]


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, bad: str = "_corrupt_record") -> DataFrame:
    """One JSON object a line, gzip by extension; blank lines give no row, broken ones have their text in `bad`."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(full.add(bad, "string") if bad not in full.names else full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_whole(rows: DataFrame, group: str, order: str, steps: int) -> DataFrame:
    """Whole groups, in order of their least `order` and then of the group, until at least `steps` rows are reached."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    taken = placed(sizes, "at", group, size=F.col("n")).where(F.col("start") < steps).select(group)
    return rows.join(taken, group, "left_semi")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header row; quotes are doubled inside quotes and values may hold newlines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def positional_sample(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of a Parquet table by their place in it: files in order of their paths, rows in order of each file. positions: (position).

    What lies before a file is a sum over one row a file.
    """
    own = df.select("*", F.col("_metadata.row_index").alias("__row"), F.col("_metadata.file_path").alias("__file"))
    before, files = 0, []
    for r in sorted(own.groupBy("__file").agg(F.count("*").alias("n")).collect(), key=lambda r: r["__file"]):
        files.append((r["__file"], before))
        before += r["n"]
    first = df.sparkSession.createDataFrame(files, "__file string, __before long")
    placed_ = own.join(F.broadcast(first), "__file").withColumn("position", F.col("__row") + F.col("__before"))
    return placed_.drop("__row", "__file", "__before").join(positions, "position", "left_semi")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of whole files under 2 GiB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tar_members(path: str, names: Iterable[str]) -> dict[str, bytes]:
    """Regular members by name; a name that leaves the archive's root is refused."""
    wanted, out = set(names), {}
    with tarfile.open(path) as archive:
        for member in archive:
            p = PurePosixPath(member.name)
            if p.is_absolute() or ".." in p.parts:
                raise ValueError(f"unsafe name {member.name}")
            if member.isfile() and member.name in wanted:
                out[member.name] = archive.extractfile(member).read()
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; an existing one is refused, and a failed write leaves no success marker."""
    df.write.mode("errorifexists").json(path)


def write_report(report: dict, path: str) -> None:
    """A small driver-side report, written beside and renamed; NaN is refused."""
    text = json.dumps(report, indent=2, sort_keys=True, allow_nan=False)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "x") as f:
        f.write(text + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_new(text: str, path: str) -> None:
    """A file that must not exist yet."""
    with open(path, "x") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())


def file_hash(path: str, block: int = 8 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


def contained(root: str, path: str) -> str:
    """The path below root; ValueError if it is absolute or leads outside."""
    full = os.path.realpath(os.path.join(root, path))
    if os.path.isabs(path) or os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{path} is not inside {root}")
    return full


def frozen_write(df: DataFrame, path: str, digest: str, recorded: str | None) -> bool:
    """Write once: True if written, False if the recorded digest is the same; any other digest is refused."""
    if recorded is None:
        df.write.mode("errorifexists").parquet(path)
        return True
    if recorded != digest:
        raise ValueError(f"{path} is frozen with another digest")
    return False


def manifest(df: DataFrame) -> DataFrame:
    """The identity fields, without texts or labels."""
    return df.select(*MANIFEST)
