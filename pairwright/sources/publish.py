"""Append-only idempotent publication: decide, then commit only the new rows.

A store is a folder of commits. Rows are written to a hidden stage folder together with a manifest, which names each file and the range
of its keys; renaming that folder to ``commit=<id>`` is the commit, one atomic step on file systems that rename folders. A writer
that dies before it leaves a stage, never half a commit; the next writer removes it. Files are cut along the keys, so a batch reads
only files whose range may hold its keys.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage

PUBLISH, NOOP, CONFLICT = "publish", "noop", "conflict"
# names that readers of the store pass over
STAGES, MANIFEST = "_stages", "_manifest"


def decide(existing: DataFrame, incoming: DataFrame, key: str, publication: str, ordinal: str) -> DataFrame:
    """Incoming rows with an ``action``.

    The publication that holds an id is the committed one, else the first incoming one; the same
    publication again is a no-op, another one is a conflict. Committed rows get ordinal -1 and one
    aggregation finds the holder, so repeated ids never multiply.
    """
    committed = existing.select(key, publication, F.lit(-1).cast("long").alias("_at"))
    arriving = incoming.select("*", F.col(ordinal).cast("long").alias("_at"))
    holder = F.struct(publication, "_at")
    holders = (
        committed.unionByName(arriving.select(key, publication, "_at"))
        .groupBy(key)
        .agg(F.min_by(holder, F.col("_at")).alias("_held"))
    )
    decided = attach(arriving, holders, [key], spread=["_at"])
    action = (
        F.when(F.col("_held._at") == F.col("_at"), PUBLISH)
        .when(F.col(f"_held.{publication}") == F.col(publication), NOOP)
        .otherwise(CONFLICT)
    )
    return decided.select(*incoming.columns, action.alias("action"))


def publish(spark: SparkSession, incoming: DataFrame, store: str, key: str, publication: str, ordinal: str) -> DataFrame:
    """Commit new publications to the ``store`` and return the decided rows.

    The decision is materialised first, so the rows committed and the rows reported are the same even
    if a task is retried. One writer at a time per store.
    """
    recover(spark, store)
    existing = committed_rows(spark, store, incoming, key)
    decided = cut_lineage(decide(existing, incoming, key, publication, ordinal))
    new = decided.where(F.col("action") == PUBLISH).drop("action")
    if not new.isEmpty():
        commit(spark, store, stage(spark, store, new, key))
    return decided


def recover(spark: SparkSession, store: str) -> int:
    """Remove what writers that died have staged; how many stages there were."""
    system, path = _located(spark, f"{store}/{STAGES}")
    if not system.exists(path):
        return 0
    left = len(system.listStatus(path))
    system.delete(path, True)
    return left


def stage(spark: SparkSession, store: str, rows: DataFrame, key: str) -> str:
    """Write rows and their manifest where no reader looks; the name of the stage."""
    name = uuid4().hex
    folder = f"{store}/{STAGES}/{name}"
    rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(folder)
    file = F.regexp_extract(F.input_file_name(), "[^/]+$", 0)
    held = spark.read.parquet(folder).select(file.alias("file"), F.col(key).alias("key"))
    ranges = held.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    ranges.withColumn("commit", F.lit(name)).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")
    return name


def commit(spark: SparkSession, store: str, name: str) -> None:
    """Make a stage part of the store."""
    system, path = _located(spark, f"{store}/{STAGES}/{name}")
    if not system.rename(path, _located(spark, f"{store}/commit={name}")[1]):
        raise RuntimeError(f"stage {name} could not be committed")


def committed_rows(spark: SparkSession, store: str, like: DataFrame, key: str) -> DataFrame:
    """The committed rows of the files that may hold a key of ``like``; none when there is no commit yet.

    Only file names come to the driver. Null keys lie in no range and are read with the rest of a file that has one.
    """
    system, path = _located(spark, store)
    pattern = f"{store}/commit=*/{MANIFEST}"
    if not system.exists(path) or not system.globStatus(_located(spark, pattern)[1]):
        return like.limit(0)
    bounds = like.agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    near = F.lit(bounds["nulls"] > 0) | ((F.col("high") >= F.lit(bounds["least"])) & (F.col("low") <= F.lit(bounds["most"])))
    files = spark.read.parquet(pattern).where(near).select("commit", "file").collect()
    if not files:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(*[f"{store}/commit={row['commit']}/{row['file']}" for row in files])


def _located(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
