"""Checkpoint listings and the status summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "checkpoint-"


def checkpoints(names: DataFrame) -> DataFrame:
    """Names that start with the prefix, with the step where it is a number."""
    return names.where(F.startswith("name", F.lit(PREFIX))).withColumn("step", F.expr(f"try_cast(substring(name, {len(PREFIX) + 1}) as bigint)"))


def latest(names: DataFrame, numeric: bool = False) -> DataFrame:
    """The latest checkpoint: by name, character by character (checkpoint-500 comes after checkpoint-1500), or by step."""
    c = checkpoints(names)
    return c.agg((F.max_by("name", "step") if numeric else F.max("name")).alias("name"))


def status(counts: dict[str, DataFrame]) -> DataFrame:
    """(what, n) for each named table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in counts.items()])


def status_report(counts: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """One row: a count for each named table, and the checkpoints in the order of their names."""
    found = checkpoints(names).agg(F.array_sort(F.collect_list("name")).alias("checkpoints"))
    wide = status(counts).groupBy().agg(*(F.max(F.when(F.col("what") == what, F.col("n"))).alias(what) for what in counts))
    return wide.join(F.broadcast(found))
