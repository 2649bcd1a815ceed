"""Session defaults and the shared folder that iterative jobs cut lineage in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("acremark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, a local session gets a fresh one for itself; on a cluster that is an error,
    as executors would not see one another's files.
    """
    configured = (
        spark.conf.get(CHECKPOINT_KEY, None)
        or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
        or spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors of {master} share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="acremark-")
    return _local_folders[application]


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read it back from there.

    The copy is on reliable storage, so losing executors in a long loop does not replay
    the rounds before it.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
