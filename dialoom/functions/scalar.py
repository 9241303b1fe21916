"""Scalar functions; all but the number format stay inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python's str.strip() removes.
PY_WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: What stands before the question in the first turn of a training record.
IMAGE_PREFIX = "<image>\n"


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: Spark's plain trim knows only U+0020."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(PY_WHITESPACE))


def strip_prompt(c: Column | str) -> Column:
    """Remove every image prefix; no trimming."""
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(IMAGE_PREFIX), F.lit(""))


def ellipsis(c: Column | str, n: int = 80) -> Column:
    """Cut to ``n`` characters, with three dots where something was cut."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def basename(c: Column | str) -> Column:
    return F.substring_index(F.col(c) if isinstance(c, str) else c, "/", -1)


def fixed(c: Column | str, digits: int = 2, width: int = 0) -> Column:
    """A number with a fixed number of digits, as text for reports.

    The binary value is rounded, ties to even, as Python and C do; the JVM's formats round the shortest
    decimal, ties up.
    """

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else f"{v:{width}.{digits}f}" for v in x], dtype=object)

    return text(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"))
