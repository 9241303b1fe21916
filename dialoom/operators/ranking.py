"""Exact global positions without a single-task window.

Range partitioning reads its input twice (for the bounds, then for the rows), so inputs are
written first. The number of ranges follows the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.session import forget, materialize, shuffle_partitions, written

#: Rows of one range.
RANGE_ROWS = 2_000_000


def _ordered(df: DataFrame, order_by: list, partitions: int | None, change: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``df`` in ranges, each sorted and changed, as a written table."""
    stored = df if written(df) else materialize(df, "unordered")
    n = partitions or max(shuffle_partitions(df.sparkSession), math.ceil(stored.count() / RANGE_ROWS))
    out = materialize(change(stored.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)), name)
    if stored is not df:
        forget(stored)
    return out


def with_global_index(df: DataFrame, order_by: list, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order_by``.

    Rows are range-partitioned and sorted, so no task sees more than its range (equal keys
    may be split when ``order_by`` ends in a unique column). The driver only gets one count
    per partition; the offsets go back as a map of that size. All columns move: give it keys
    and join the rest, or use :func:`running_total`.
    """
    stored = _ordered(df, order_by, partitions, lambda x: x.withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_mid", 33)
    counts = stored.groupBy(part.alias("p")).count().collect()
    offset, start = [], 0
    for r in sorted(counts, key=lambda r: r.p):
        offset += [(r.p, start)]
        start += r["count"]
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    if not offset:
        return stored.withColumn(name, local).drop("_mid")
    base = F.broadcast(df.sparkSession.createDataFrame(offset, "_p bigint, _base bigint"))  # one row a partition
    return stored.withColumn("_p", part).join(base, "_p").withColumn(name, F.col("_base") + local).drop("_mid", "_p", "_base")


def running_total(df: DataFrame, keys: list[str], n: str, name: str, partitions: int | None = None) -> DataFrame:
    """(keys, ``name``): the sum of ``n`` over all rows before this one in the order of ``keys``, which are unique."""
    stored = _ordered(df.select(*keys, F.col(n).alias("_n")), keys, partitions, lambda x: x.withColumn("_part", F.spark_partition_id()), "totals")
    offset, start = [], 0
    for r in sorted(stored.groupBy("_part").agg(F.sum("_n").alias("n")).collect(), key=lambda r: r._part):
        offset.append((r._part, start))
        start += r.n
    base = F.broadcast(df.sparkSession.createDataFrame(offset, "_part int, _base bigint"))  # one row a partition
    # a task sums one range
    before = F.sum("_n").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return stored.withColumn("_before", F.coalesce(before, F.lit(0))).join(base, "_part").select(*keys, (F.col("_base") + F.col("_before")).alias(name))
