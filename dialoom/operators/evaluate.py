"""Scoring predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import py_strip, strip_prompt
from dialoom.functions.similarity import similarity
from dialoom.operators.dialogue import first_of


def prompts_by_role(records: DataFrame, *keep: str) -> DataFrame:
    """Question and truth: first human and first gpt value; the prompt prefix goes, and the ends are trimmed."""
    return records.select(*keep, "id", py_strip(strip_prompt(first_of("human"))).alias("question"), first_of("gpt").alias("truth"))


def prompts_by_position(records: DataFrame, *keep: str) -> DataFrame:
    """Question and truth by position, whatever the roles; the prefix goes, nothing is trimmed."""
    at = lambda i: F.get("conversations", F.lit(i)).value
    return records.select(*keep, "id", strip_prompt(at(0)).alias("question"), at(1).alias("truth"))


def scored(predictions: DataFrame, with_similarity: bool = False) -> DataFrame:
    """Add ``exact_match`` (equal after stripping) and, on demand, ``similarity``.

    A null prediction or truth gives null: the row was requested, but not scored.
    """
    out = predictions.withColumn("exact_match", py_strip("prediction") == py_strip("ground_truth"))
    return out.withColumn("similarity", similarity("prediction", "ground_truth")) if with_similarity else out


def exact_match_report(rows: DataFrame, denominator: str = "scored") -> DataFrame:
    """Rates in percent over the scored rows, or over all requested ones; 0.0 without rows."""
    hits = F.count_if(F.coalesce("exact_match", F.lit(False)))
    n = F.count("exact_match") if denominator == "scored" else F.count("*")
    return rows.agg(F.count("*").alias("n_requested"), F.count("exact_match").alias("n_scored"), hits.alias("n_match"), F.coalesce(F.try_divide(hits.cast("double"), n) * 100, F.lit(0.0)).alias("exact_match_pct"))


def similarity_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("similarity").alias("n_scored"), F.coalesce(F.avg("similarity") * 100, F.lit(0.0)).alias("avg_similarity_pct"))


def eval_report(rows: DataFrame, checkpoint: str, order: str = "pred_id", details: int = 20) -> DataFrame:
    """One row: the rates and the first ``details`` scored rows by position."""
    good = rows.where(F.col("exact_match").isNotNull())
    first = good.orderBy(order).limit(details)
    detail = first.agg(F.array_sort(F.collect_list(F.struct(order, "id", "question", "ground_truth", "prediction", "exact_match", "similarity"))).alias("results"))
    sums = good.agg(F.count("*").alias("num_samples"), F.coalesce(F.avg(F.col("exact_match").cast("double")) * 100, F.lit(0.0)).alias("exact_match"), F.coalesce(F.avg("similarity") * 100, F.lit(0.0)).alias("avg_similarity"))
    return sums.join(F.broadcast(detail)).withColumn("checkpoint", F.lit(checkpoint)).select("checkpoint", "num_samples", "exact_match", "avg_similarity", "results")


def best_per_id(rows: DataFrame) -> DataFrame:
    """The last scored prediction of each id: a maximum, combined before the shuffle."""
    last = F.struct(F.coalesce(F.col("scored_at").cast("timestamp"), F.to_timestamp(F.lit("0001-01-01"))), F.col("pred_id"))
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), last).alias("r")).select("r.*")
