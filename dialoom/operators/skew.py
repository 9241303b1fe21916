"""Joins whose left side may have hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are spread.
SALTS = 8


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with a table that has one row a key; any key may hold a large part of ``rows``.

    Rows of a key are spread by a hash of the row (not at random, so a task that runs again gives
    the same rows), and the table is repeated: every row of it ``salts`` times, which suits a table
    much smaller than ``rows``; or, where the large keys are known, those of ``hot`` (on, parts)
    alone as often as it says. ``hot`` goes to all tasks, so it must be of a proven size. What is
    skewed still, AQE splits.
    """
    which = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    if hot is None:
        left = rows.withColumn("_salt", F.pmod(which, F.lit(salts)).cast("int"))
        right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        parts = F.coalesce("_parts", F.lit(1))
        few = F.broadcast(hot.select(*on, F.col("parts").cast("int").alias("_parts")))
        left = rows.join(few, on, "left").withColumn("_salt", F.pmod(which, parts).cast("int")).drop("_parts")
        right = table.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
