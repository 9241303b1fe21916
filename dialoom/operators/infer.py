"""Batch inference around an answerer the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answerer = Callable[[str | None, str | None], str]


def batch_infer(rows: DataFrame, make_answerer: Callable[[], Answerer], image: str = "image", question: str = "question") -> DataFrame:
    """Add ``prediction`` and ``error``; a row the answerer fails on gets its error text.

    ``make_answerer`` runs once per Python worker (a model is loaded there, not per row).
    """

    @F.pandas_udf("prediction string, error string")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = make_answerer()
        for images, questions in batches:
            out = []
            for i, q in zip(images, questions):
                try:
                    out.append((ask(i, q), None))
                except Exception as e:  # one bad row must not end the job
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["prediction", "error"])

    return rows.withColumn("_a", answer(F.col(image), F.col(question))).select("*", "_a.prediction", "_a.error").drop("_a")


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull()).drop("error")


def failed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull())
