"""Sources. Readers take an explicit schema wherever one is known, so nothing is inferred."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom import schemas

log = logging.getLogger(__name__)


def file_system(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return bool(fs.exists(p))


def require(spark: SparkSession, path: str) -> str:
    """The path if it exists, else a clear error before any job starts."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def table(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame:
    """A Parquet table ``{base}/{name}.parquet`` (file or folder)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{base}/{name}.parquet")


def corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The nested corpus; ``split`` picks one value of a split column or folder."""
    df = spark.read.parquet(require(spark, path))
    return df if split is None else df.where(F.col("split") == split)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Format-B records from JSON Lines or from one pretty-printed top-level array.

    JSON Lines split across tasks. An array file can't be split: one task per file.
    """
    head = spark.read.text(require(spark, path)).select(F.trim("value").alias("v")).where("v <> ''").limit(1).collect()
    array = bool(head) and head[0].v.startswith("[")
    return spark.read.schema(schemas.RECORD).option("multiLine", array).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTION).json(require(spark, path))


def images(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(require(spark, path))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Names in a folder, one row each."""
    p, fs = file_system(spark, require(spark, path))
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return spark.createDataFrame([(n,) for n in names], schemas.CHECKPOINTS)


def sample_count(spark: SparkSession, path: str) -> int:
    """Number of records of a record file (not of its lines)."""
    return records(spark, path).count()


def row_at(df: DataFrame, index: int, position: str = "original_index") -> DataFrame:
    """Positional lookup over an explicit position column; file order is never relied on."""
    return df.where(F.col(position) == index)


def load_config(path: str) -> dict:
    """A YAML file as a dict; a failure is logged and raised again."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except Exception:
        log.exception("can't read %s", path)
        raise
