"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(
    app: str = "pairwright", master: str = "local[8]", shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster ``shuffle_partitions`` should be large (about 128 MB of shuffle data per
    partition before coalescing); adaptive execution shrinks it for small inputs.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared checkpoint folder and forget how it was made.

    Reliable checkpoints live on shared storage, so a lost executor costs a re-read and not
    a recomputation of every earlier round.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """The tables of an iterative job, written to the shared folder one round after the other.

    A written table has a known size. A checkpoint keeps the size its plan was estimated at, which for joins of joins squares
    with every round until planning itself takes the time. Each round replaces the one before it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.round = 0

    def keep(self, frame: DataFrame, forget: bool = True) -> DataFrame:
        """Write ``frame``, made from the round before, and ``forget`` that round."""
        self.round += 1
        frame.write.parquet(f"{self.folder}/{self.round}")
        if forget:
            delete_folder(self.spark, f"{self.folder}/{self.round - 1}")
        return self.spark.read.parquet(f"{self.folder}/{self.round}")

    def close(self, frame: DataFrame) -> DataFrame:
        """The result as a checkpoint, which is removed with its last reference, and no table left behind."""
        frame = cut_lineage(frame)
        delete_folder(self.spark, self.folder)
        return frame
