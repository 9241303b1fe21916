"""Deterministic splits and heads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.session import forget, materialize

#: Rows that are left to sort on the driver when the cut is looked for.
FEW = 1000


def _cut(hashes: DataFrame, share: float) -> tuple[str, str | None] | None:
    """The (hash, key) at floor(n * share) in their order: counts by the next four digits lead to it."""
    prefix, rank = "", None
    while True:
        rows = hashes.where(F.startswith("_h", F.lit(prefix))) if prefix else hashes
        counts = rows.groupBy(F.substring("_h", len(prefix) + 1, 4).alias("d")).count().collect()  # at most 65,536
        if rank is None:
            rank = math.floor(sum(r["count"] for r in counts) * share)
        for r in sorted(counts, key=lambda r: r.d):
            if rank < r["count"]:
                break
            rank -= r["count"]
        else:
            return None
        prefix += r.d
        if r["count"] <= FEW:
            found = hashes.where(F.startswith("_h", F.lit(prefix))).orderBy("_h", "_key").collect()
            return found[rank]._h, found[rank]._key
        if len(prefix) == 32:  # one key, many times
            return prefix, hashes.where(F.col("_h") == prefix).agg(F.min("_key")).first()[0]


def shuffle_split(df: DataFrame, key: str = "id", share: float = 0.9, seed: int = 42) -> DataFrame:
    """An exact split: the first floor(n * share) rows in the order of md5("{seed}:{key}") train.

    The same rows come out on any cluster and in any engine with md5. (A pseudo-random
    permutation of another runtime isn't reproduced.) Sizes are exact, unlike randomSplit's, but
    for rows with equal keys, which share a side. Only keys are read to find where to cut; then
    each row is compared with that one value, and nothing is shuffled. A null key comes last.
    """
    h = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit("g" * 32))
    hashes = materialize(df.select(h.alias("_h"), F.col(key).cast("string").alias("_key")), "hashes")
    at = _cut(hashes, share)
    forget(hashes)
    if at is None:  # nothing is left for the other side
        return df.withColumn("split", F.lit("train"))
    first = (h < at[0]) | ((h == at[0]) & (F.col(key).cast("string") < F.lit(at[1])))
    return df.withColumn("split", F.when(first, "train").otherwise("val"))


def split_summary(df: DataFrame) -> DataFrame:
    counts = df.groupBy("split").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("split", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an explicit position (top-k, no full sort)."""
    return df.orderBy(*order).limit(n)
