"""Sequence similarity (Ratcliff-Obershelp), which has no SQL form."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str | None, b: str | None) -> float | None:
    """``SequenceMatcher(None, a, b).ratio()`` on lower-cased text; null in, null out.

    The ratio is not symmetric and uses the junk heuristic from 200 characters of ``b`` on,
    so the order (prediction, ground truth) matters and the defaults stay.
    """
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(DoubleType())
def similarity(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b) for a, b in zip(prediction, truth)], dtype="Float64").astype("object").where(lambda s: s.notna(), None)
