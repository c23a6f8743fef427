"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from skysift.sources import files


BYTES_PER_PARTITION = 64 * 1024 * 1024
# Beyond this many the driver's record of map outputs grows too large: then partitions grow instead.
MOST_PARTITIONS = 20_000


def shuffle_width(size: int) -> int:
    """Initial shuffle partitions for so many bytes of input."""
    return min(size // BYTES_PER_PARTITION, MOST_PARTITIONS)


def prepare(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Event times are instants, counted in UTC; generated code and shuffles are sized.

    Generated methods beyond 8000 bytes are never compiled by the JVM and run many
    times slower; with the limit set, Spark splits such projections instead.
    For a large ``folder`` the initial number of shuffle partitions grows with its
    bytes, so that a partition fits in an executor's memory; adaptive execution
    merges the ones that turn out small.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if folder:
        wanted = shuffle_width(files.size(spark, folder))
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
        else:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the checkpoint folder the cluster names.

    A local session without one gets a temporary folder; a cluster session must
    name its own, because executors cannot see each other's disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skysift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/skysift-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    return f"{_application_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, survives executor loss,
    and lets the optimizer see the real size."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application staged; call it once no result needs it any more."""
    files.remove(spark, _application_folder(spark))
