"""Corpus statistics: counts, lengths, histograms, value counts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.dialogue import is_assistant, positional

# The vocabulary sizes that are reported.
COVERAGE_SIZES = (100, 500, 1000, 2000, 5000, 10_000)


def dialogue_sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")).withColumn("n_pairs", F.expr("n_turns div 2"))


def turn_stats(turns: DataFrame) -> DataFrame:
    """Average, least and most turns per dialogue; average and total of floor(turns / 2)."""
    return dialogue_sizes(turns).agg(
        F.count("*").alias("n_dialogues"), F.avg("n_turns").alias("avg_turns"), F.min("n_turns").alias("min_turns"), F.max("n_turns").alias("max_turns"),
        F.avg("n_pairs").alias("avg_pairs"), F.sum("n_pairs").alias("total_pairs"),
    )


def qa_length_stats(turns: DataFrame) -> DataFrame:
    """Lengths of positional questions and answers, in one pass; nulls are skipped."""
    n = F.length("content").cast("bigint")
    cols = []
    for kind in ("question", "answer"):
        v = F.when(F.col("kind") == kind, n)
        cols += [F.count(v).alias(f"n_{kind}s"), F.avg(v).alias(f"avg_{kind}_len"), F.min(v).alias(f"min_{kind}_len"), F.max(v).alias(f"max_{kind}_len")]
    return positional(turns).agg(*cols)


def length_stats(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column).cast("bigint")
    return df.agg(F.count(n).alias("n"), F.avg(n).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


def pairs_histogram(turns: DataFrame) -> DataFrame:
    """Unit bins from 0 to the largest value, empty bins included."""
    counts = dialogue_sizes(turns).groupBy(F.col("n_pairs").alias("bin")).agg(F.count("*").alias("n"))
    bins = counts.agg(F.max("bin").alias("hi")).where("hi is not null").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hi"))).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def equal_width_histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """``bins`` equal bins over [min, max], the last closed on the right.

    Values are counted first (lengths take few values), so the bounds and the bins come
    from that small table and the data is read once. All values equal: the range is
    widened by half on either side, as plotting libraries do. No value: no rows.
    """
    counts = df.select(value.cast("bigint").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi")).where("lo is not null")
    bounds = bounds.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = counts.join(F.broadcast(bounds)).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1).cast("bigint")))
    got = placed.groupBy("bin").agg(F.sum("n").alias("n"))
    frame = bounds.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return frame.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def assistant_texts(turns: DataFrame) -> DataFrame:
    """Every assistant turn, paired or not, as (value, conv_id, turn)."""
    return turns.where(is_assistant()).select(F.col("content").alias("value"), "conv_id", "turn")


def value_counts(df: DataFrame, value: str, position: list[str] | None = None) -> DataFrame:
    """(value, n[, first]): counts, with the place of the first occurrence as tie-break."""
    first = [F.min(F.struct(*position)).alias("first")] if position else []
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), *first)


def cardinality(df: DataFrame, value: str) -> DataFrame:
    """Total and distinct values, both exact."""
    return value_counts(df, value).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_values"))


def top_k(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent values with their rank; equal counts keep first-seen order."""
    order = [F.desc("n"), F.asc("first")]
    best = counts.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("rank", "value", "n")


def coverage(counts: DataFrame, sizes: tuple[int, ...] = COVERAGE_SIZES) -> DataFrame:
    """Share of all occurrences that the K most frequent values make, for K <= distinct.

    Only the top max(K) counts, a bounded number, enter the running sum.
    """
    spark = counts.sparkSession
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))
    w = Window.orderBy(F.desc("n"))
    top = counts.select("n").orderBy(F.desc("n")).limit(max(sizes))
    run = top.select(F.row_number().over(w).cast("bigint").alias("k"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"))
    want = spark.createDataFrame([(k,) for k in sizes], "k bigint")
    return run.join(F.broadcast(want), "k").join(F.broadcast(totals)).where("k <= distinct_values").select("k", (F.col("covered") / F.col("total") * 100).alias("pct"))


def rank_frequency(counts: DataFrame, limit: int = 5000) -> DataFrame:
    """The frequencies by rank, the first ``limit`` of them."""
    top = counts.select("n").orderBy(F.desc("n")).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"))).cast("bigint").alias("rank"), "n")
