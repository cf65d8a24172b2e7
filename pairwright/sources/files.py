"""File trees: digest scans with budgets, and the layout audit of a release folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex
from pairwright.functions.scalars import path_ancestors
from pairwright.operators.bindings import membership


def file_metadata(spark: SparkSession, root: str) -> DataFrame:
    """``(path, byte_length)`` relative to ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(relative_path(root).alias("path"), F.col("length").alias("byte_length"))


def tree_digests(spark: SparkSession, root: str, maximum_file_bytes: int) -> DataFrame:
    """``(path, byte_length, sha256, code)``.

    The length filter reaches the reader, so contents of files over the budget are never loaded;
    those files keep a null digest and a code.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = relative_path(root).alias("path")
    size = F.col("length").alias("byte_length")
    text = F.lit(None).cast("string")
    read = files.where(F.col("length") <= maximum_file_bytes).select(
        path, size, sha256_hex(F.col("content")).alias("sha256"), text.alias("code")
    )
    over = files.where(F.col("length") > maximum_file_bytes).select(
        path, size, text.alias("sha256"), F.lit("tree.file_bytes").alias("code")
    )
    return read.unionByName(over)


def tree_budget_issues(
    files: DataFrame, maximum_files: int, maximum_bytes: int, maximum_directories: int, maximum_depth: int
) -> DataFrame:
    """``(code, value, maximum)`` for every budget of a whole tree that its file metadata breaks.

    Counts are aggregated in parallel; directories are the distinct ancestors of the paths.
    """
    depth = F.size(F.split("path", "/")) - 1
    sums = files.agg(
        F.count(F.lit(1)).alias("tree.files"),
        F.coalesce(F.sum("byte_length"), F.lit(0)).alias("tree.bytes"),
        F.coalesce(F.max(depth), F.lit(0)).cast("long").alias("tree.depth"),
    )
    directories = files.select(F.explode(path_ancestors(F.col("path"))).alias("d")).distinct().agg(
        F.count(F.lit(1)).alias("tree.directories")
    )
    limits = {"tree.files": maximum_files, "tree.bytes": maximum_bytes, "tree.depth": maximum_depth}
    rows = [(sums, code, limit) for code, limit in limits.items()] + [(directories, "tree.directories", maximum_directories)]
    parts = [
        frame.select(F.lit(code).alias("code"), F.col(f"`{code}`").alias("value"), F.lit(limit).cast("long").alias("maximum"))
        for frame, code, limit in rows
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.where("value > maximum")


def relative_path(root: str):
    clean = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    return F.expr("substring_index(path, '" + clean.replace("'", "\\'") + "/', -1)")


def release_topology(files: DataFrame, committed: DataFrame, entries: Sequence[str]) -> DataFrame:
    """Every committed id owns exactly one folder holding exactly ``entries``."""
    expected = committed.select(
        "release_id", F.explode(F.array(*[F.lit(e) for e in entries])).alias("entry")
    )
    actual = files.select(
        F.substring_index("path", "/", 1).alias("release_id"),
        F.expr("substring(path, instr(path, '/') + 1)").alias("entry"),
    )
    return membership(["release_id", "entry"], expected, actual)
