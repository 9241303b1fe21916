"""Cutting oversized texts into pieces at natural boundaries, with overlap.

Method: content-defined chunking. A hash rolls over successive words; the words with the
least hash among those within reach of a cut are landmarks, and the cut snaps from the
landmark to the nearest natural boundary - heading, paragraph, line, sentence, else word -
between the least and the largest size. Landmarks depend on the words around them only, so
an edit moves the cuts beside it and later ones fall where they fell before.

Sizes are counted in tokens and checked on the finished piece. A piece starts up to
``overlap`` tokens before the end of the piece before it, at a word. Text without any
boundary, and any word larger than a quarter of the limit, is cut between characters at
landmarks of its own. Pieces cover the text without gaps. A text of at most ``most`` tokens is one piece.

Null and empty texts, and texts without a key, give no piece. Repeated rows give equal pieces. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import token_sizes
from dialoom.llm.token_sizes import Sizer

WORD, SENTENCE, LINE, PARAGRAPH, HEADING = range(5)
KINDS = ("word", "sentence", "line", "paragraph", "heading", "end")

_ENDS = regex.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_ENUMERATION = regex.compile(r"^\W*(?:\p{N}{1,3}|\p{L})[.)]$")
_HEADING = regex.compile(r"^(?:#{1,6}$|#{1,6}\p{L})")
class _Units(dict):
    """What is known of a chunk: an index into growing arrays of size, hash and boundary level."""

    def __init__(self, sizer: Sizer):
        super().__init__()
        self.sizer = sizer
        self.rows: list[tuple[int, int, int, bool, int]] = []

    def __missing__(self, chunk: str) -> int:
        body = chunk.rstrip("\r\n")
        size = len(self.sizer.encoding.encode_ordinary(" " + chunk))
        level = WORD
        if chunk.endswith("\n"):
            level = LINE if body.strip() else PARAGRAPH
        elif _ENDS.search(chunk) and not _ENUMERATION.match(chunk):
            level = SENTENCE
        self.rows.append((size, zlib.crc32(chunk.encode()), level, bool(_HEADING.match(body)), len(chunk)))
        self[chunk] = out = len(self.rows) - 1
        return out

    def tidy(self) -> None:
        """Keep memory bounded; called between texts."""
        if len(self.rows) > 1_000_000:
            self.clear()
            self.rows.clear()


def _micro(chunk: str, most: int) -> list[str]:
    """A run without spaces in small parts, of ``most`` / 16 characters at most, that end at landmarks of their own."""
    out, start, longest = [], 0, max(1, min(32, most // 16))
    least = min(4, longest)
    for i in range(least, len(chunk) + 1):
        if i - start >= longest or (i - start >= least and zlib.crc32(chunk[i - least : i].encode()) % 12 == 0):
            out.append(chunk[start:i])
            start = i
    return [*out, chunk[start:]] if start < len(chunk) else out


def _chunks(text: str, most: int, units: _Units) -> tuple[list[str], list[int]]:
    """Words with the line breaks after them, and the white space (0 or 1) that follows each.

    A word of more than a quarter of ``most`` tokens is taken apart (a token is a byte at least).
    """
    words, gaps = [], []
    for line in text.split("\n"):
        parts = line.split(" ")
        words += parts
        gaps += [1] * (len(parts) - 1) + [0]
        words[-1] += "\n"
    words[-1] = words[-1][:-1]
    room = most // 4
    if any(4 * len(w) >= room and len(w.encode()) >= room for w in set(words)):
        fine, after = [], []
        for w, g in zip(words, gaps):
            large = 4 * len(w) >= room and len(w.encode()) >= room and (len(w) > 2 * most or units.rows[units[w]][0] > room)
            parts = _micro(w, most) if large else [w]
            fine += parts
            after += [0] * (len(parts) - 1) + [g]
        words, gaps = fine, after
    return words, gaps


_ROLL = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 5)]


def cut(text: str, units: _Units, most: int, least: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, kind of boundary at the end, tokens) of the pieces of one text."""
    sizer = units.sizer
    if not text:
        return []
    if len(text) <= most and len(text.encode()) <= most:
        return [(0, len(text), len(KINDS) - 1, sizer.size(text))]
    # every word takes a token at least, so texts of many words need no count
    if text.count(" ") <= most or len(text.split()) <= most:
        whole = sizer.size(text)
        if whole <= most:
            return [(0, len(text), len(KINDS) - 1, whole)]
    units.tidy()
    words, gaps = _chunks(text, most, units)
    at = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
    seen, inverse = np.unique(at, return_inverse=True)
    size, hashed, level, heads, length = (np.array(c)[inverse] for c in zip(*(units.rows[i] for i in seen)))
    total = np.concatenate([[0], np.cumsum(size)])  # before each word
    place = np.concatenate([[0], np.cumsum(length + np.array(gaps))])  # first character of each word
    level = level.copy()
    level[:-1][heads[1:] & (level[:-1] >= LINE)] = HEADING
    roll = np.zeros(len(words), np.uint64)
    h = hashed.astype(np.uint64)
    for k in range(4):
        roll[k:] += h[: len(h) - k] * _ROLL[k]
    roll ^= roll >> np.uint64(31)
    roll *= np.uint64(0x94D049BB133111EB)

    out, start, last, n = [], 0, 0, len(words)
    while True:
        room = most
        while True:
            limit = int(np.searchsorted(total, total[start] + room, side="right")) - 1  # words start..limit-1 fit
            if limit >= n:
                end, kind = n, len(KINDS) - 1
            else:
                low = min(int(np.searchsorted(total, total[last] + least, side="left")), limit)
                end, kind = _choose(level, roll, total, max(low, last + 1), max(limit, last + 1))
            a, b = int(place[start]), min(int(place[end]), len(text))
            tokens = sizer.size(text[a:b])
            if tokens <= most or room <= most // 4:
                break
            room -= max(8, tokens - most)  # seams cost a few tokens more than the words alone
        if tokens > most and start < last:  # rather less overlap than a piece too large
            start = last
            continue
        out.append((a, b, kind, tokens))
        if end >= n:
            return out
        last = end
        start = min(last, max(int(np.searchsorted(total, total[last] - overlap, side="left")), int(np.searchsorted(total, total[start], side="right"))))


def _choose(level: np.ndarray, roll: np.ndarray, total: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The cut among ``low``..``high`` (numbers of words before it), and its kind."""
    if low >= high:
        return high, int(level[high - 1])
    marks = roll[low - 1 : high]
    land = low + int(marks.argmin())
    kinds = level[low - 1 : high]
    spread = total[high] - total[low]
    away = np.abs(total[low : high + 1] - total[land])
    for kind, share in ((HEADING, 1.0), (PARAGRAPH, 0.5), (LINE, 0.4), (SENTENCE, 1.0)):
        near = np.flatnonzero((kinds >= kind) & (away <= share * spread))
        if len(near):
            best = near[away[near].argmin()]
            return low + int(best), int(kinds[best])
    return land, int(level[land - 1])


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 512, least: int = 160, overlap: int = 64, vocabulary: str = token_sizes.DEFAULT) -> DataFrame:
    """(key, piece, start, end, boundary, tokens, text): numbered pieces, positions in characters.

    ``boundary`` names what the piece ends at; ``least`` is the least size of what a piece
    adds to the one before it (the last may be smaller).
    """
    if not 0 <= overlap < least < most - overlap:
        raise ValueError("0 <= overlap < least < most - overlap must hold")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = _Units(Sizer.get(vocabulary))
        for pdf in batches:
            rows = [(k, p, a, b, KINDS[kind], n, t[a:b]) for k, t in zip(pdf["key"], pdf["text"]) for p, (a, b, kind, n) in enumerate(cut(t, units, most, least, overlap))]
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "end", "boundary", "tokens", "text"])

    wanted = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and length(text) > 0")
    out = wanted.mapInPandas(run, "key bigint, piece int, start int, end int, boundary string, tokens int, text string")
    return out.withColumnRenamed("key", key) if key != "key" else out
