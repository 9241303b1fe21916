"""Batch evaluation as one call: records, prompts, answers, scores, report, files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import evaluate, infer, split
from dialoom.operators.infer import Answerer
from dialoom.sinks import write_predictions, write_report


@dataclass(frozen=True)
class Decoding:
    """How an answerer decodes: it samples only if the temperature is above zero, else it is greedy."""

    temperature: float = 0.7
    top_p: float = 0.9
    max_new_tokens: int = 512

    @property
    def sample(self) -> bool:
        return self.temperature > 0


def image_path(folder: str):
    """Where the picture of a record is."""
    return F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("image"))


def batch_evaluate(records: DataFrame, make_answerer: Callable[[], Answerer], output: str | None = None, folder: str = "images", position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answer every record and score the answers: (predictions, report).

    Question and truth are the first human and the first gpt value. A record that the answerer fails
    on is left out of the predictions, but counts as requested. With ``output`` the predictions are
    written as one JSON array, in the order of ``position`` if there is one.
    """
    keep = [position] if position else []
    asked = evaluate.prompts_by_role(records, "image", *keep).withColumn("image", image_path(folder))
    answered = infer.batch_infer(asked, make_answerer)
    found = infer.succeeded(answered).select(*keep, "id", "question", F.col("truth").alias("ground_truth"), "prediction")
    scored = answered.withColumn("ground_truth", F.col("truth"))
    report = evaluate.exact_match_report(evaluate.scored(scored))
    if output:
        write_predictions(found.orderBy(*keep) if keep else found, output)
    return found, report


def evaluate_model(records: DataFrame, make_answerer: Callable[[], Answerer], checkpoint: str, num_samples: int = 100, position: str = "row_id", output: str | None = None, folder: str = "images") -> DataFrame:
    """The report over the first ``num_samples`` records (all of them if it isn't positive): rates and first results.

    Question and truth go by position in the record, untrimmed. With ``output`` the report is written as JSON.
    """
    rows = split.head(records, num_samples, position) if num_samples > 0 else records
    asked = evaluate.prompts_by_position(rows, "image", position).withColumn("image", image_path(folder))
    answered = infer.succeeded(infer.batch_infer(asked, make_answerer)).withColumn("ground_truth", F.col("truth"))
    report = evaluate.eval_report(evaluate.scored(answered, with_similarity=True), checkpoint, position)
    if output:
        write_report(report, output)
    return report


def ask(spark: SparkSession, make_answerer: Callable[[], Answerer], image: str, question: str) -> str:
    """One question about one picture; what the answerer raises is raised here, too."""
    row = infer.batch_infer(spark.createDataFrame([(image, question)], "image string, question string"), make_answerer).first()
    if row.error is not None:
        raise RuntimeError(row.error)
    return row.prediction
