"""Session helpers: a local session for tests, and the lineage cut used by iterative work."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use.

    On a cluster the session comes from the submitter; nothing here is required there
    except UTC as the session time zone.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.maintenanceInterval", "10s")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local session (tests, the benchmark) that names none gets a folder of its own; on a
    cluster that is an error, since every executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="folioforge-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, prefix: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver's JVM ends; Hadoop heeds this only if it is there already."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when the result
    is no longer referenced.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back.

    Unlike :func:`cut_lineage` the planner knows its true size, so a join against it
    becomes a broadcast only if it is small.  Its files are compressed.
    """
    path = scratch_path(df.sparkSession, "written")
    df.write.options(**options).parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
