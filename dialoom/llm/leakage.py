"""Evaluation passages inside a training corpus.

Method: winnowing. Words are compared without case, accents, punctuation and look-alike
differences. Every window of ``window`` successive k-grams keeps its least k-gram, on both
sides by the same order, so any shared run of ``k + window - 1`` words has a common
fingerprint. The order is by the number of passages that have a k-gram, then by hash: common
ones are kept only where a window has nothing more telling. Fingerprints of corpus and test set are
joined, and each hit is extended along its diagonal: a document contains an item if at
least ``least`` words in a row of the item's passage are there, ``altered`` of them at most
changed (a few insertions and deletions may shift the rest), and so many of the passage's
telling k-grams (those few other items have) are whole that it isn't merely the same stock
wording with another content.

An item's instruction and question are no part of its passage: sentences and leading clauses
at its ends that stand beside ``STOCK`` or more different sentences are stock phrases and are cut
off. A passage that several items share keeps its sentences, for they stand side by side each time;
word statistics count it once.

Scale. The test set is the stated query set. Up to ``block_chars`` characters go to the workers
at once; a larger set goes in blocks whose real size is checked (long items in overlapping parts),
one pass over the corpus and one index at a time, with statistics of the whole set. The corpus
is never shuffled; only hits leave a task. A text of any length is handled in time linear in it.
Copies of a document are documents of their own.

Nulls and empty texts contain nothing, and a document without a key is in no result. Items with short passages can't leak by definition.
Repeated rows give one result. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.lookalikes import look, no_accents
from dialoom.session import materialize

#: Characters of test text that go to the workers at once.
BLOCK_CHARS = 8_000_000

_NUMBER = regex.compile(r"(?<=\p{N})[.,](?=\p{N}{3}(?!\p{N}))")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def norm_words(text: str) -> list[str]:
    return [no_accents(w).casefold() for w in _WORD.findall(_NUMBER.sub("", look(text)))]


def _segments(text: str) -> list[list[str]]:
    return [w for w in (norm_words(s) for s in regex.split(r"(?<=[.!?])\s+|(?<=:)\s+|\n+", look(text))) if w]


#: Different neighbours from which a sentence at an item's end is a stock phrase.
STOCK = 3


def neighbours(segments: list[list[str]]) -> Iterator[tuple[str, str, str]]:
    """(sentence, "after" or "before", the sentence on that side) of one text; and (sentence, "in", the text's digest)."""
    flat = [" ".join(w) for w in segments]
    text = hashlib.blake2b("\n".join(flat).encode(), digest_size=8).hexdigest()
    for x in flat:
        yield x, "in", text
    for x, y in zip(flat, flat[1:]):
        yield x, "after", y
        yield y, "before", x


def stock_phrases(beside: Iterable[tuple[str, str, str]]) -> tuple[set[str], set[str]]:
    """Phrases that open texts and phrases that close them, from :func:`neighbours` of all texts.

    An instruction stands before different passages and a question after different ones. The
    sentences of a passage that several items share have the same neighbours in all of them, but
    for what opens and closes the items, which doesn't count.
    """
    near: dict[str, dict[str, set[str]]] = {side: defaultdict(set) for side in ("after", "before", "in")}
    for x, side, y in beside:
        near[side][x].add(y)

    def spread(side: str, other: str, found: set[str]) -> set[str]:
        """With phrases of several texts that stand only beside stock phrases."""
        recur = [x for x, texts in near["in"].items() if len(texts) >= STOCK and near[side].get(x)]
        while more := {x for x in recur if x not in found and near[side][x] <= found and near[other].get(x, set()) <= found}:
            found = found | more
        return found

    sides = (("after", "before"), ("before", "after"))
    apart = lambda side, but: {x for x, ys in near[side].items() if len(ys - but) >= STOCK}
    first = {side: apart(side, set()) for side, _ in sides}
    likely = {side: spread(side, other, apart(side, first[other])) for side, other in sides}
    opening, closing = (spread(side, other, apart(side, likely[other])) for side, other in sides)
    return opening, closing


def passages(texts: Mapping[Any, str], opening: set[str] | None = None, closing: set[str] | None = None, ends: Mapping[Any, tuple[bool, bool]] | None = None) -> dict[Any, list[str]]:
    """The words of each item without stock phrases at its ends.

    ``ends``: of a part of a long item, whether its beginning and its end are the item's.
    """
    parts = {i: _segments(t) for i, t in texts.items() if t}
    if opening is None or closing is None:
        opening, closing = stock_phrases(x for p in parts.values() for x in neighbours(p))
    out = {}
    for i, p in parts.items():
        flat = [" ".join(w) for w in p]
        from_start, to_end = ends[i] if ends else (True, True)
        a, b = 0, len(p)
        while from_start and a < b and flat[a] in opening:
            a += 1
        while to_end and b > a and flat[b - 1] in closing:
            b -= 1
        out[i] = [w for s in p[a:b] for w in s]
    return out


def _grams_of(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


class _Index:
    """The winnowed fingerprints of one block of test passages, ready to be sent to workers."""

    def __init__(self, items: Mapping[Any, list[str]], shared: Counter | None, n_passages: int | None, k: int, window: int, least: int, altered: float, telling: float):
        """``items``: words by key, or by (key, part). ``shared``: in how many different passages of
        the whole set each k-gram is; by default those of ``items``."""
        items = {i: w for i, w in items.items() if len(w) >= least}
        self.k, self.window, self.least, self.altered, self.telling = k, window, least, altered, telling
        names = sorted(items, key=lambda i: i if isinstance(i, tuple) else (i, 0))
        self.keys = np.array([i[0] if isinstance(i, tuple) else i for i in names], dtype=np.int64)
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({x for w in items.values() for x in w}))}
        self.words = [np.array([self.vocabulary[x] for x in items[i]], dtype=np.int32) for i in names]
        each = [self._grams(w) for w in self.words]
        spelled = [_grams_of(items[i], k) for i in names]
        if shared is None or n_passages is None:  # these are the whole set
            different = {tuple(gs) for gs in spelled}
            shared, n_passages = Counter(g for gs in different for g in set(gs)), len(different)
        grams = {h: shared[g] for hs, gs in zip(each, spelled) for h, g in zip(hs.tolist(), gs)}
        self.grams = np.array(sorted(grams), dtype=np.uint64)
        count = np.array([grams[int(g)] for g in self.grams], dtype=np.uint64)
        # the order of fingerprints: by the number of passages, then by hash
        self.rank = np.minimum(count, np.uint64(0x7FFF)) << np.uint64(48) | _mix(self.grams) >> np.uint64(16)
        few = count <= max(1, 0.02 * n_passages)
        self.rare = [np.concatenate([np.zeros(k - 1, bool), few[np.searchsorted(self.grams, g)]]) for g in each]
        post: list[tuple[int, int, int]] = []
        for n, g in enumerate(each):
            at = np.searchsorted(self.grams, g)
            for q in np.flatnonzero(self._kept(self.rank[at])):
                post.append((int(at[q]), n, int(q)))
        post.sort()
        table = np.array(post, dtype=np.int64).reshape(-1, 3)
        self.post_item, self.post_at = table[:, 1], table[:, 2]
        self.start = np.searchsorted(table[:, 0], np.arange(len(self.grams) + 1))
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.flat = np.concatenate([*self.words, np.zeros(1, np.int32)]).astype(np.int32)
        self.first = np.cumsum(np.append(0, self.length[:-1])) if len(self.words) else np.zeros(0, np.int64)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(self.k):
            h = (h + ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _kept(self, rank: np.ndarray) -> np.ndarray:
        """Which k-grams are the least of some window of successive ones."""
        n, w = len(rank), self.window
        if n == 0:
            return np.zeros(0, bool)
        if n <= w:
            return rank == rank.min()
        low = reduce(np.minimum, [rank[j : n - w + 1 + j] for j in range(w)])
        kept = np.zeros(n, bool)
        for j in range(w):
            kept[j : n - w + 1 + j] |= rank[j : n - w + 1 + j] == low
        return kept

    def search(self, texts: list[str | None], cache: "_Ids") -> list[tuple[int, int]]:
        """(index of a text, item) for each text that contains an item."""
        arrays, owner = [], []
        for n, t in enumerate(texts):
            if t:
                ids = cache.of(t)
                if len(ids) >= self.least:
                    arrays.append(ids)
                    owner.append(n)
        if not arrays or not len(self.grams):
            return []
        gap = np.full(self.k, -1, np.int32)  # no gram spans two texts
        flat = np.concatenate([x for a in arrays for x in (a, gap)])
        begin = np.cumsum([0] + [len(a) + self.k for a in arrays[:-1]])
        end = begin + np.array([len(a) for a in arrays])
        g = self._grams(flat)
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        rank = np.where(self.grams[at] == g, self.rank[at], np.uint64(0xFFFFFFFFFFFFFFFF))
        hit = np.flatnonzero(self._kept(rank) & (rank != np.uint64(0xFFFFFFFFFFFFFFFF)))
        if not len(hit):
            return []
        a = at[hit]
        counts = self.start[a + 1] - self.start[a]
        pos = np.repeat(hit, counts)
        within = np.arange(len(pos)) - np.repeat(np.cumsum(counts) - counts, counts)
        p = np.repeat(self.start[a], counts) + within
        item, q = self.post_item[p], self.post_at[p]
        if not len(item):
            return []
        off = pos - q
        text = np.searchsorted(begin, pos, side="right") - 1
        # around each hit: the most words that agree within ``least`` successive ones
        reach = self.least + self.k
        around = np.arange(-reach, reach + 1)
        agree = np.zeros(len(off), np.int16)
        for s in range(0, len(off), 100_000):
            c = slice(s, s + 100_000)
            there, here = pos[c, None] + around, q[c, None] + around
            inside = (here >= 0) & (here < self.length[item[c], None])
            same = self.flat[np.where(inside, here + self.first[item[c], None], 0)] == flat[np.clip(there, 0, len(flat) - 1)]
            same &= inside & (there >= begin[text[c], None]) & (there < end[text[c], None])
            run = np.cumsum(same, axis=1, dtype=np.int16)
            run[:, self.least :] -= run[:, : -self.least].copy()
            agree[c] = run.max(1)
        # diagonals that lie close together make one alignment
        pair = text * len(self.keys) + item
        order = np.lexsort((off, pair))
        pair, off, agree, text, item = pair[order], off[order], agree[order], text[order], item[order]
        fresh = np.append(True, (np.diff(pair) != 0) | (np.diff(off) != 0))
        top = np.maximum.reduceat(agree, np.flatnonzero(fresh))
        pair, off, text, item = pair[fresh], off[fresh], text[fresh], item[fresh]
        head = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(off) > 4)))
        need = (1 - self.altered) * self.least
        enough = (np.add.reduceat(top.astype(np.int64), head) >= need) & (np.maximum.reduceat(top, head) >= need / 2)
        out, done = [], set()
        stop = np.append(head[1:], len(pair))
        for u in np.flatnonzero(enough):
            a, b = head[u], stop[u]
            t, i = int(text[a]), int(item[a])
            if (t, i) not in done and self._contains(flat[begin[t] : end[t]], i, off[a:b] - begin[t]):
                done.add((t, i))
                out.append((owner[t], int(self.keys[i])))
        return out

    def _contains(self, ids: np.ndarray, item: int, offsets: np.ndarray) -> bool:
        """Extension: the best window over diagonals that lie close together."""
        w, rare = self.words[item], self.rare[item]
        n = len(w)
        same = np.zeros(n, bool)
        masks = []
        for o in offsets:
            where = np.arange(n) + o
            ok = (where >= 0) & (where < len(ids))
            m = np.zeros(n, bool)
            m[ok] = ids[where[ok]] == w[ok]
            masks.append(m)
        best = max(masks, key=np.sum)
        for m in masks:
            same |= m if m is best else m & (np.append(m[1:], False) | np.append(False, m[:-1]))
        if same.sum() < (1 - self.altered) * self.least:
            return False
        # telling k-grams, by their last word: those few items have
        whole = rare.copy()
        for d in range(self.k):
            whole[d:] &= same[: n - d]
        have, tells, told = (np.concatenate([[0], np.cumsum(x)]) for x in (same, rare, whole))
        starts = np.flatnonzero(same)
        reach = 16 * self.least  # longer spans have good ones of this length within them
        for c in range(0, len(starts), 1024):
            own = starts[c : c + 1024]
            ends = starts[c : np.searchsorted(starts, own[-1] + reach, side="right")] + 1
            size = ends[None, :] - own[:, None]
            match = have[ends][None, :] - have[own][:, None]
            inner = np.minimum(own + self.k - 1, n)
            of, got = tells[ends][None, :] - tells[inner][:, None], told[ends][None, :] - told[inner][:, None]
            near = ((got >= self.telling * of) & (got >= 2)) | (match >= (1 - self.altered / 3) * size)
            if ((size >= self.least) & (size <= reach) & (match >= (1 - self.altered) * size) & near).any():
                return True
        return False


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


class _Ids(dict):
    """Raw white-space tokens to word ids; most tokens are seen again and again."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.many = vocabulary, []

    def __missing__(self, token: str) -> int:
        ids = [self.vocabulary.get(w, 0) for w in norm_words(token)]
        if len(ids) <= 1:
            out = ids[0] if ids else _NO_WORD
        else:
            self.many.append(ids)
            out = _NO_WORD - len(self.many)
        self[token] = out
        return out

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        if len(self) + len(tokens) > 2_000_000:  # memory stays bounded whatever the corpus holds
            self.clear()
            self.many.clear()
        a = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        least = a.min(initial=0)
        if least < _NO_WORD:  # tokens of several words
            parts, last = [], 0
            for n in np.flatnonzero(a < _NO_WORD):
                parts += [a[last:n], np.array(self.many[_NO_WORD - 1 - a[n]], np.int32)]
                last = n + 1
            a = np.concatenate([*parts, a[last:]])
        return a[a != _NO_WORD] if least < 0 else a


_NO_WORD = -2


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", least: int = 18, k: int = 3, window: int = 4, altered: float = 0.14, telling: float = 0.45, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id): every document that contains part of an item's passage."""
    spark = docs.sparkSession
    queries = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where(F.col("k").isNotNull() & (F.length("t") > 0)).distinct()
    corpus = docs.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text"))
    options = (k, window, least, altered, telling)
    chars = queries.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars <= block_chars:
        own = passages({(r.k, n): r.t for n, r in enumerate(queries.collect())})
        return _search(corpus, spark.sparkContext.broadcast(_Index(own, None, None, *options))).distinct()
    # parts of long items overlap, so no span of ``least`` words is cut; stock phrases go at an item's ends only
    part = max(1, block_chars // 16)
    at = F.posexplode(F.sequence(F.lit(0), F.length("t") - 1, F.lit(part)))
    parts = queries.select("k", "t", at.alias("p", "at")).select("k", "p", F.substring("t", F.col("at") + 1, F.lit(part + 64 * least)).alias("t"), (F.col("p") == 0).alias("first"), (F.col("at") + part >= F.length("t")).alias("last"))
    parts, blocks = materialize(parts, "items"), math.ceil(2 * chars / block_chars)
    block = lambda n: F.pmod(F.xxhash64("k", "p"), F.lit(n))
    while parts.groupBy(block(blocks).alias("b")).agg(F.sum(F.length("t")).alias("n")).agg(F.max("n")).first()[0] > 1.5 * block_chars:
        blocks *= 2
    found = []
    for b in range(blocks):
        rows = parts.where(block(blocks) == b).collect()  # their size is checked above
        own = {(r.k, r.p): r.t for r in rows}
        opening, closing, grams, n = _statistics(parts, own, k)
        kept = passages(own, opening, closing, {(r.k, r.p): (r["first"], r["last"]) for r in rows})
        index = spark.sparkContext.broadcast(_Index(kept, grams, n, *options))
        found.append(materialize(_search(corpus, index), "leaks"))
        index.destroy()
    return reduce(DataFrame.unionByName, found).distinct()


def _statistics(parts: DataFrame, own: Mapping[Any, str], k: int) -> tuple[set[str], set[str], Counter, int]:
    """Stock phrases of one block, in how many different passages of all its k-grams are, and the number of passages."""

    def wanted_of(t: str) -> set[str]:
        segments = _segments(t)
        return {"s " + " ".join(s) for s in segments} | {"g " + g for g in _grams_of([w for s in segments for w in s], k)}

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for t in pdf["t"]:
                segments = _segments(t)
                out.update(("s " + x, f"{side} {y}") for x, side, y in neighbours(segments))
                # a passage goes by its longest sentence: items that share it count once
                name = " ".join(max(segments, key=len)) if segments else ""
                out.update(("g " + g, name) for g in _grams_of([w for s in segments for w in s], k))
            yield pd.DataFrame(sorted(out), columns=["x", "y"])

    spark = parts.sparkSession
    wanted = spark.createDataFrame([(x,) for x in {x for t in own.values() for x in wanted_of(t)}], "x string")
    seen = parts.select("t").mapInPandas(spell, "x string, y string").join(wanted, "x", "left_semi").distinct()
    beside = [(r.x[2:], *r.y.split(" ", 1)) for r in seen.where(F.startswith("x", F.lit("s "))).withColumn("_r", F.row_number().over(Window.partitionBy("x", F.substring_index("y", " ", 1)).orderBy("y"))).where(F.col("_r") <= 4 * STOCK).collect()]
    grams = Counter({r.x[2:]: r.n for r in seen.where(F.startswith("x", F.lit("g "))).groupBy("x").agg(F.count("*").alias("n")).collect()})
    opening, closing = stock_phrases(beside)
    return opening, closing, grams, parts.select("k").distinct().count()


def _search(docs: DataFrame, index) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        cache = _Ids(ix.vocabulary)
        for pdf in batches:
            keys = pdf["doc_id"].to_numpy()
            out = ix.search(pdf["text"].tolist(), cache)
            yield pd.DataFrame({"item_id": [i for _, i in out], "doc_id": [keys[n] for n, _ in out]})

    return docs.where("doc_id is not null and length(text) > 0").mapInPandas(run, "item_id bigint, doc_id bigint")
