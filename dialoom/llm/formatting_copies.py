"""Copies hidden by formatting: white space, letter case, punctuation, order of fields.

Method. Each record gets its canonical key (one string). Records are range-partitioned by
(group, key, id) and sorted externally within each range; one scan over adjacent rows,
comparing full keys, finds the runs of equal records. A run is represented by its smallest
id. Because the id belongs to the range key, a text that fills a third of all rows is
spread over many ranges; runs that cross a range boundary are joined afterwards from two
digests per range, the only thing the driver sees.

The key is the look of the text (``lookalikes``) without white space, punctuation and case.
Contents of three or more ``label: value`` fields, or a JSON object, give the sorted list
of their fields instead. Symbols such as emoji and letters with other accents stay distinct.

Nulls, texts with fewer than ``least`` letters and digits and rows without an id have no key and no copies.
Repeated rows (equal ids) count as copies of one another and yield no pair of an id with
itself. Very long texts are keyed and compared in full. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialoom.llm.lookalikes import bare, look
from dialoom.operators.ranking import RANGE_ROWS
from dialoom.session import forget, materialize, shuffle_partitions

_EDGE = r"[\s\p{P}$+<=>^`|~]*"
_OBJECT = regex.compile(rf"{_EDGE}?(\{{.*\}}){_EDGE}", regex.S)
_SEPARATOR = regex.compile(r"\s*(?:[;|\n]|\r)\s*")
_FIELD = regex.compile(r"([^:：]{1,60})[:：](.*)", regex.S)
_CONTENT = regex.compile(r"[\p{L}\p{N}]+")


def fields_of(seen: str) -> list[tuple[str, str]] | None:
    """The (label, value) pairs of a JSON object or of three or more labelled fields."""
    if "{" in seen:
        m = _OBJECT.fullmatch(seen)
        if m:
            try:
                pairs = json.loads(m[1], object_pairs_hook=lambda ps: ps)
                if pairs and isinstance(pairs, list) and isinstance(pairs[0], tuple):
                    return [(bare(k), bare(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))) for k, v in pairs]
            except (ValueError, RecursionError):
                pass
    if seen.count(":") + seen.count("：") >= 3:
        parts = [p for p in _SEPARATOR.split(seen) if _CONTENT.search(p)]
        if len(parts) >= 3:
            found = [_FIELD.fullmatch(p) for p in parts]
            if all(m is not None and _CONTENT.search(m[1]) for m in found):
                return [(bare(m[1]), bare(m[2])) for m in found]
    return None


def record_key(text: str | None, least: int = 40) -> str | None:
    """The canonical key of a text; null if it is null or has too few letters and digits."""
    if text is None:
        return None
    seen = look(text)
    n = 0
    for m in _CONTENT.finditer(seen):
        n += m.end() - m.start()
        if n >= least:
            break
    if n < least:
        return None
    fields = fields_of(seen)
    if fields is not None:
        return ("{" if seen.lstrip(" \t\n\r\"'(>*-#").startswith("{") else ":") + "\x1e".join(sorted(f"{k}\x1f{v}" for k, v in fields))
    return bare(seen)


def keyed(df: DataFrame, column: str, out: str = "key", least: int = 40) -> DataFrame:
    @F.pandas_udf(StringType())
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([record_key(t, least) for t in texts], dtype=object)

    return df.withColumn(out, key(F.col(column))).where(F.col(out).isNotNull())


def _digest(*parts: str) -> str:
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal (tab, key) among sorted rows; at the end one boundary row."""
    part = TaskContext.get().partitionId()
    first = last = None
    keep, runs = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        tabs, keys, ids = pdf["tab"].tolist(), pdf["key"].tolist(), pdf["id"].tolist()
        keeps, heads = [], []
        for t, k, i in zip(tabs, keys, ids):
            if last is None or k != last[1] or t != last[0]:
                last, keep = (t, k), i
                runs += 1
                first = first or last
            keeps.append(keep)
            heads.append(runs == 1)
        yield pd.DataFrame({"tab": tabs, "id": ids, "keep_id": keeps, "head": heads, "part": part, "first": None, "last": None})
    if first is not None:
        yield pd.DataFrame({"tab": [None], "id": [None], "keep_id": [keep], "head": [runs == 1], "part": [part], "first": [_digest(*first)], "last": [_digest(*last)]})


def sorted_runs(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(tab, id, keep_id) for records (tab, id, key): keep_id is the smallest id with that key."""
    spark = records.sparkSession
    # range partitioning reads its input twice (bounds, then rows): keys are made once
    keys = materialize(records.select("tab", "key", "id"), "keys")
    n = partitions or max(shuffle_partitions(spark), math.ceil(keys.count() / RANGE_ROWS))
    ordered = keys.repartitionByRange(n, "tab", "key", "id").sortWithinPartitions("tab", "key", "id")
    scanned = materialize(ordered.mapInPandas(_scan, "tab string, id bigint, keep_id bigint, head boolean, part int, first string, last string"), "runs")
    forget(keys)
    fixes, before, true_keep = [], None, None
    for b in sorted(scanned.where("first is not null").collect(), key=lambda b: b.part):
        joined = b["first"] == before
        if joined:
            fixes.append((b.part, true_keep))
        true_keep = true_keep if joined and b["head"] else b.keep_id
        before = b["last"]
    rows = scanned.where("first is null").select("tab", "id", "keep_id", "head", "part")
    if not fixes:
        return rows.select("tab", "id", "keep_id")
    fix = F.broadcast(spark.createDataFrame(fixes, "part int, _keep bigint"))  # at most one row per range
    return rows.join(fix, "part", "left").select("tab", "id", F.when(F.col("head"), F.coalesce("_keep", "keep_id")).otherwise(F.col("keep_id")).alias("keep_id"))


def copies(df: DataFrame, column: str, key: str, by: str, least: int = 40) -> DataFrame:
    """(tab, keep_id, copy_id): each further row of a group of equal records."""
    records = keyed(df.select(F.col(by).alias("tab"), F.col(key).alias("id"), F.col(column).alias("_text")).where(F.col("id").isNotNull() & (F.length("_text") >= least // 2)), "_text", "key", least)
    return sorted_runs(records).where("id <> keep_id").select("tab", "keep_id", F.col("id").alias("copy_id"))


def collapsed(df: DataFrame, column: str, key: str, by: str, least: int = 40) -> DataFrame:
    """(tab, keep_id, n_copies): one representative per text and the number of its rows."""
    records = keyed(df.select(F.col(by).alias("tab"), F.col(key).alias("id"), F.col(column).alias("_text")).where(F.col("id").isNotNull() & (F.length("_text") >= least // 2)), "_text", "key", least)
    return sorted_runs(records).groupBy("tab", "keep_id").agg(F.count("*").alias("n_copies"))
