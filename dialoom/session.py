"""Session helpers: where intermediate tables live, and how they are written.

Long plans are cut with *written tables*, not with in-memory checkpoints: a Parquet table
in the shared folder named by ``spark.checkpoint.dir`` survives the loss of any executor
and is computed once (``Dataset.checkpoint`` computes its plan twice).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``; only where that is unset (tests, local runs) a
    temporary folder is made and stored in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="dialoom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str, suffix: str = "") -> str:
    """A new path in the shared folder; what is there is deleted when the process ends."""
    path = f"{shared_dir(spark)}/dialoom-{name}-{uuid.uuid4().hex}{suffix}"
    if not _written:
        atexit.register(_tidy)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    schema = df.schema
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._dialoom_path = path
    return out


def written(df: DataFrame) -> bool:
    """Whether ``df`` is a table that :func:`materialize` returned."""
    return getattr(df, "_dialoom_path", None) is not None


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _tidy() -> None:
    """Delete what this process left in the shared folder, while its session still lives."""
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is None:
                return
            _delete(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_dialoom_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of a few small files on all cores; what has enough partitions stays as it is.

    For inputs of work that costs more than moving the rows (Python per row). Only for
    plans without a shuffle, whose partitions are known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def local_session(cores: int | str | None = None, app: str = "dialoom") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
