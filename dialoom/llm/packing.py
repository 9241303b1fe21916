"""Filling containers of a fixed token capacity with texts of uneven length.

Method. The histogram of all sizes (at most one row per size up to the capacity) goes to
the driver, where dynamic programming chooses the length buckets with the least total
padding. Containers are token-budget batches over these buckets: recipes, each a list of
buckets whose bounds fit the capacity together, found by filling the largest bucket first
and then the largest that still fits, and repeated as long as their buckets last. A bucket
alone leaves up to half a container unused once its bound passes half the capacity;
recipes over several buckets don't. The k-th item of a bucket has a fixed place in the
recipes, so items are placed by their rank alone, found by a range sort.

A text that fits a container is never split. A larger one is cut at spaces into full pieces
and a rest, which is an item like any other; only a run without spaces that alone exceeds
the capacity is cut inside, between characters. Pieces joined give the text again.

Null and empty texts have nothing to place and get no row; neither do texts without a key. Repeated rows are placed each.
Equal sizes are placed in the order of the key. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import token_sizes
from dialoom.llm.token_sizes import Sizer
from dialoom.operators.ranking import with_global_index
from dialoom.session import materialize


def split_text(sizer: Sizer, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive pieces of at most ``capacity`` tokens."""
    n = sizer.size(text)
    if n <= capacity:
        return [(0, len(text), n)] if text else []
    out = []
    start, end, used, at = 0, 0, 0, 0
    words = text.split(" ")
    for i, w in enumerate(words):
        chunk = w if i == 0 else " " + w
        size = sizer.exact(chunk) if i == 0 else sizer._sizes[w]
        if used + size > capacity and end > start:
            out.append((start, end))
            start, used = end, 0
        if size > capacity:
            out += _inside(sizer, text, at, at + len(chunk), capacity)
            start = end = at + len(chunk)
            used = 0
        else:
            end = at + len(chunk)
            used += size
        at += len(chunk)
    if end > start:
        out.append((start, end))
    done = []
    for a, b in out:  # white space at the seams may change a size by a little
        m = sizer.size(text[a:b])
        done += [(a, b, m)] if m <= capacity else [(x, y, sizer.size(text[x:y])) for x, y in _inside(sizer, text, a, b, capacity)]
    return done


def _inside(sizer: Sizer, text: str, start: int, end: int, capacity: int) -> list[tuple[int, int]]:
    """Cuts between characters, as late as the capacity allows."""
    out = []
    while start < end:
        reach = 8 * capacity
        stop = min(end, start + reach)
        ids = sizer.encoding.encode_ordinary(text[start:stop])
        while len(ids) < capacity and stop < end:  # few tokens of many characters
            reach *= 2
            stop = min(end, start + reach)
            ids = sizer.encoding.encode_ordinary(text[start:stop])
        if len(ids) > capacity:
            whole = sizer.encoding.decode_bytes(ids[:capacity]).decode("utf-8", "ignore")
            stop = start + max(1, len(whole))
            while sizer.exact(text[start:stop]) > capacity and stop > start + 1:
                stop -= max(1, (stop - start) // 64)
        out.append((start, stop))
        start = stop
    return out


def items(docs: DataFrame, key: str, text: str, capacity: int, vocabulary: str = token_sizes.DEFAULT) -> DataFrame:
    """(key, piece, start, end, tokens): what has to be placed; positions in characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = Sizer.get(vocabulary)
        for pdf in batches:
            rows = [(k, p, a, b, n) for k, t in zip(pdf["key"], pdf["text"]) for p, (a, b, n) in enumerate(split_text(sizer, t, capacity))]
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "end", "tokens"])

    wanted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and length(text) > 0")
    return wanted.mapInPandas(run, "key bigint, piece int, start int, end int, tokens int")


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if len(sizes) <= buckets:
        return sizes.tolist()
    count = np.array([histogram[s] for s in sizes], dtype=np.float64)
    n = len(sizes)
    number, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    top = np.concatenate([[0], sizes]).astype(np.float64)
    # one bucket of the sizes q + 1 .. p wastes padding(q, p), which is concave (Monge): the best q
    # never falls as p grows, so each layer is solved by divide and conquer, all middles of a depth at once
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = np.zeros((buckets, n + 1), np.int32)
    step = 1 << max(0, n.bit_length() - 1)
    for k in range(buckets):
        after, choice = np.full(n + 1, np.inf), np.zeros(n + 2, np.int64)
        choice[n + 1] = n
        known = np.array([0, n + 1])  # borders whose choice bounds their neighbours'
        after[0] = 0.0
        width = step
        while width:
            p = np.arange(width, n + 1, 2 * width)
            at = np.searchsorted(known, p)
            low, high = choice[known[at - 1]], np.minimum(choice[known[at]], p)
            size = high - low + 1
            first = np.cumsum(size) - size
            q = np.arange(size.sum()) - np.repeat(first - low, size)
            pp = np.repeat(p, size)
            value = best[q] + top[pp] * (number[pp] - number[q]) - (mass[pp] - mass[q])
            after[p] = np.minimum.reduceat(value, first)
            hit = np.flatnonzero(value == np.repeat(after[p], size))
            choice[p] = q[hit[np.searchsorted(hit, first)]]
            known = np.sort(np.concatenate([known, p]))
            width //= 2
        best, back[k] = after, choice[: n + 1]
    bounds, p = set(), n
    for k in range(buckets - 1, -1, -1):
        if p > back[k][p]:
            bounds.add(int(sizes[p - 1]))
        p = int(back[k][p])
    return sorted(bounds)


def recipes(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(containers, {bucket: items of it in each}) that use up all items."""
    left = list(counts)
    order = [b for b in range(len(bounds) - 1, -1, -1) if left[b]]
    out = []
    while order:
        room, used = capacity, {}
        for b in order:
            if left[b] and bounds[b] <= room:
                n = min(left[b], room // bounds[b]) if bounds[b] else left[b]
                used[b] = n
                room -= n * bounds[b]
        times = min(left[b] // n for b, n in used.items())
        for b, n in used.items():
            left[b] -= times * n
        out.append((times, used))
        order = [b for b in order if left[b]]
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, buckets: int = 128, vocabulary: str = token_sizes.DEFAULT) -> DataFrame:
    """(key, piece, start, end, tokens, bucket, container) for every piece of every text."""
    spark = docs.sparkSession
    todo = materialize(items(docs, key, text, capacity, vocabulary), "items")
    histogram = {r.tokens: r["count"] for r in todo.groupBy("tokens").count().collect()}  # at most capacity rows
    bounds = best_bounds(histogram, buckets) if histogram else []
    counts = [0] * len(bounds)
    for size, n in histogram.items():
        counts[int(np.searchsorted(bounds, size))] += n
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    taken, first = [0] * len(bounds), 0
    legs: list[tuple[int, int, int]] = []  # (global rank from, items per container, first container)
    for times, used in recipes(bounds, counts, capacity):
        for b, n in used.items():
            legs.append((int(begin[b]) + taken[b], n, first))
            taken[b] += times * n
        first += times
    legs.sort()
    plan = spark.sparkContext.broadcast((np.array(bounds, np.int64), np.array(legs, np.int64).reshape(-1, 3)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits, table = plan.value
        for pdf in batches:
            leg = table[np.searchsorted(table[:, 0], pdf["rank"].to_numpy(), side="right") - 1]
            yield pdf.assign(bucket=limits[np.searchsorted(limits, pdf["tokens"].to_numpy())], container=leg[:, 2] + (pdf["rank"].to_numpy() - leg[:, 0]) // leg[:, 1]).drop(columns="rank")

    ranked = with_global_index(todo, ["tokens", "key", "piece", "start"], "rank").select("key", "piece", "start", "end", "tokens", "rank")
    placed = ranked.mapInPandas(place, "key bigint, piece int, start int, end int, tokens int, bucket bigint, container bigint")
    return placed.withColumnRenamed("key", key) if key != "key" else placed


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, their least possible number, and how full they are."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    return each.agg(
        F.count("*").alias("containers"), F.ceil(F.sum("used") / capacity).alias("least_containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.coalesce(F.try_divide(F.sum("used").cast("double"), F.count("*") * capacity), F.lit(0.0)).alias("fill"),
    )
