"""Records of evaluation splits that are in the training split, exactly or almost.

Method. Texts (question and answer) are brought to a normal form and collapsed to distinct
ones, so copies are matched once. Character 3-grams of a text give minwise hashes, cut into
bands; a bucket is one band with the digits of both fields, which must agree. Two families
of buckets are filled in one pass: within a picture, and over texts alone (for answers of
at least ``least`` characters). Only buckets with rows of both sides give candidates.

Candidates whose bitmaps of 3-grams rule the similarity out are dropped (an exact bound); the
others are decided by their exact Jaccard similarity, ``similarity`` or more. A check follows, for another name or number in the same sentence leaves texts similar: words
are aligned, and all that differs must be a slip of the pen (a letter dropped, doubled or
swapped, a space misplaced), a word that moved, or a function word. Numbers must agree.

Crowded buckets. A bucket with more than ``crowd`` texts of one side is split further by
bands of more hashes, salted; nothing is dropped. Verification sees each pair of distinct
texts once, whichever family or picture brought it.

Normal form: look (``lookalikes``), case, punctuation and forms of address removed, fields
of a record in sorted order, digit groups joined. If one side is written without accents,
the accents of the other don't count.

A null key, question or answer overlaps nothing; a null picture number equals none. Empty texts
have no words and overlap nothing. Very long texts are hashed in time linear in them and
aligned only if their similarity suffices. Repeated rows give a pair each. Empty tables give
an empty result. Extra columns play no part. Building a query runs the jobs that fill its
intermediate tables.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.formatting_copies import fields_of
from dialoom.llm.lookalikes import look, no_accents
from dialoom.session import forget, materialize

_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*")
_APART = regex.compile(r"\n|[;|:,]\s")
_DIGITS = regex.compile(r"\p{N}+$")

# Vietnamese forms of address that may open or close an utterance, without accents.
POLITE_START = (("ban", "oi"), ("thua", "ban"), ("thua", "anh"), ("thua", "chi"), ("thua", "quy", "khach"), ("da", "thua"), ("da", "vang"), ("da",), ("vang",), ("xin", "chao"), ("chao", "ban"), ("cho", "hoi"), ("cho", "minh", "hoi"), ("cho", "toi", "hoi"), ("lam", "on"), ("vui", "long"), ("xin", "hoi"), ("xin",), ("a",), ("u",), ("uh",), ("oi",), ("theo", "toi"))
POLITE_END = (("a",), ("vay",), ("vay", "a"), ("vay", "ban"), ("nhe",), ("nhi",), ("the",), ("ha",), ("nha",), ("vay", "nhi"), ("ban", "oi"), ("voi", "a"), ("dung", "khong"))
# Function words of Vietnamese, the closed classes, without accents.
STOP_WORDS = frozenset(
    # articles, classifiers, plural
    "buc cac cai chiec con cuon moi nhung tam to "
    # copula, modals, aspect
    "bat bi can co cung da dang dau deu duoc hay la phai se the van vua "
    # prepositions and conjunctions
    "bang boi cho cua de den do duoi gan hoac khi ma nen neu nhu o qua sau tai theo thi trong tren truoc tu va vao ve vi voi "
    # pronouns, demonstratives, question words
    "ai anh ban chi day em gi kia minh nao nay no noi ta toi sao "
    # particles
    "a ha lam luc lai len nha nhe nhi oi ra rang rat roi thoi thua u vay vang xin".split()
)


_STARTS = sorted(POLITE_START, key=len, reverse=True)
_ENDS = sorted(POLITE_END, key=len, reverse=True)


@lru_cache(1 << 17)
def flat(word: str) -> str:
    return no_accents(word)


@lru_cache(1 << 16)
def _opening(first: tuple[str, ...]) -> int:
    """Words of the form of address that the first (at most four) words of a text begin with; it's never the whole text."""
    return next((len(p) for p in _STARTS if len(p) < len(first) and (first[: len(p)] == p or len(p) > 1 and all(map(slip, first, p)))), 0)


@lru_cache(1 << 16)
def _closing(last: tuple[str, ...]) -> int:
    return next((len(p) for p in _ENDS if len(p) < len(last) and last[len(last) - len(p) :] == p), 0)


def _strip(ws: list[str], plain: list[str]) -> tuple[list[str], list[str]]:
    while len(ws) > 1:
        a = _opening(tuple(plain[:4]))
        ws, plain = ws[a:], plain[a:]
        b = _closing(tuple(plain[-3:]))
        ws, plain = ws[: len(ws) - b], plain[: len(plain) - b]
        if not a and not b:
            break
    return ws, plain


def normal_words(text: str) -> list[str]:
    """Words of the normal form, accents kept."""
    seen = look(text)
    fields = fields_of(seen)
    if fields is not None:
        # labels and values by the order of their labels
        parts = sorted(regex.split(r"\s*[;|\n\r]\s*|\",\s*", seen.casefold()), key=lambda p: no_accents(regex.sub(r"[^\p{L}\p{N}:]+", "", p)))
        seen = " \n ".join(parts)
    ws: list[str] = []
    glue = False
    last = 0
    for m in _WORD.finditer(seen.casefold()):
        w = m[0]
        if glue and w[0].isdigit() and _DIGITS.fullmatch(w) and not _APART.search(seen, last, m.start()):
            ws[-1] += w
        else:
            ws.append(w)
        glue = w[0].isdigit() and _DIGITS.fullmatch(w) is not None
        last = m.end()
    return _strip(ws, [flat(w) for w in ws])[0] if fields is None else ws


@lru_cache(1 << 13)
def _question(value: str) -> str:
    return " ".join(question_words(value))  # questions recur


def question_words(value: str) -> list[str]:
    return normal_words(value.replace("<image>", " "))


def _hash(s: str) -> int:
    return zlib.crc32(s.encode())


class _Rows(dict):
    """The row of each string in a table of its hashes, made when it is first asked for."""

    def __init__(self, table: _Minwise):
        super().__init__()
        self.table = table

    def __missing__(self, gram: str) -> int:
        self[gram] = i = len(self)
        self.table.fill(i, _hash(gram))
        return i


class _Minwise:
    """Minwise hashes of sets of strings; the hashes of a string are made once and looked up.

    The table of a worker is emptied when it is full, so its memory is bounded.
    """

    def __init__(self, n: int, seed: int, most: int = 1 << 14):
        r = np.random.default_rng(seed)
        self.a, self.b = r.integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 62, n, dtype=np.uint64)
        self.most, self.at = most, _Rows(self)
        self.table, self.plain = np.empty((1024, n), np.uint32), np.empty(1024, np.int64)

    def fill(self, i: int, value: int) -> None:
        if i == len(self.table):
            self.table, self.plain = (np.concatenate([t, np.empty_like(t)]) for t in (self.table, self.plain))
        h = (np.uint64(value) + self.b) * self.a
        h ^= h >> np.uint64(29)
        self.table[i] = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
        self.plain[i] = value

    def of(self, grams: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """The least value of each hash, and one plain hash of every string."""
        if len(self.at) + len(grams) > self.most:
            self.at.clear()
        rows = np.fromiter(map(self.at.__getitem__, grams), np.int64, len(grams))
        out = self.table[rows[:1024]].min(0)
        for s in range(1024, len(rows), 1024):
            out = np.minimum(out, self.table[rows[s : s + 1024]].min(0))
        return out, self.plain[rows]


def _fold(key: np.ndarray, hashes: np.ndarray, rows: int, n: int) -> np.ndarray:
    """Buckets (texts x n) of n bands of ``rows`` hashes each, under a key per text."""
    s = hashes[:, : rows * n].astype(np.uint64).reshape(len(hashes), n, rows)
    h = key[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        h = (h ^ s[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def grams(q: list[str], a: list[str]) -> set[str]:
    """Character 3-grams of the words of question and answer, without accents."""
    out: set[str] = set()
    for tag, ws in (("q", q), ("a", a)):
        s = " " + " ".join(map(flat, ws)) + " "
        out.update([tag + s[i : i + 3] for i in range(max(1, len(s) - 2))])
    return out


def digits(ws: list[str]) -> str:
    """The digits of a text's numbers, sorted: equal for texts of which ``same_words`` holds."""
    return "".join(sorted([c for w in ws if w[0].isdigit() for c in flat(w) if c.isdigit()]))


def jaccard(x: set[str], y: set[str]) -> float:
    return len(x & y) / len(x | y) if x or y else 0.0


def slip(x: str, y: str) -> bool:
    """Whether two words differ by one dropped, doubled or swapped letter."""
    if x == y:
        return True
    if len(x) > len(y):
        x, y = y, x
    longer = len(y) - len(x)
    if longer > 1 or not x or x[0].isdigit() or y[0].isdigit():
        return False
    i = 0
    for c, d in zip(x, y):
        if c != d:
            break
        i += 1
    if longer:
        return x[i:] == y[i + 1 :]
    return i + 1 < len(x) and x[i] == y[i + 1] and x[i + 1] == y[i] and x[i + 2 :] == y[i + 2 :]


def same_words(x: list[str], y: list[str]) -> bool:
    """Whether two word lists say the same: slips and fact-free words aside."""
    if x == y:
        return True
    px, py = [flat(w) for w in x], [flat(w) for w in y]
    if all(map(str.isascii, x)) or all(map(str.isascii, y)) or sum(a != b for a, b in zip(x, px)) == 0 or sum(a != b for a, b in zip(y, py)) == 0 or _half_accented(x, y):
        x, y = px, py
        if x == y:
            return True
    nx, ny = [w for w in x if w[0].isdigit()], [w for w in y if w[0].isdigit()]
    if sorted(nx) != sorted(ny) and "".join(nx) != "".join(ny):
        return False
    if abs(len(x) - len(y)) > 4 + 0.1 * max(len(x), len(y)):
        return False
    cx, cy = Counter(x), Counter(y)
    if _foreign(list((cx - cy).elements()), list((cy - cx).elements())):
        return False
    left_x, left_y, slips = [], [], 0
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        a, b = x[i1:i2], y[j1:j2]
        joined = "".join(a), "".join(b)
        if a and b and (joined[0] == joined[1] or (len(a) != len(b) and slip(*joined))):
            slips += 1
            continue
        for w in list(a):
            for v in list(b):
                if slip(w, v):
                    a.remove(w)
                    b.remove(v)
                    slips += 1
                    break
        left_x += a
        left_y += b
    # words that moved
    common = Counter(left_x) & Counter(left_y)
    moved = sum(common.values())
    left_x, left_y = list((Counter(left_x) - common).elements()), list((Counter(left_y) - common).elements())
    for w in list(left_x):
        for v in list(left_y):
            if slip(w, v):
                left_x.remove(w)
                left_y.remove(v)
                slips += 1
                break
    n = max(len(x), len(y))
    if moved > max(2, 0.3 * n) or slips > max(2, 0.25 * n):
        return False
    rest = [flat(w) for w in left_x + left_y]
    return len(rest) <= max(4, 0.3 * n) and all(w in STOP_WORDS for w in rest)


def _foreign(only_x: list[str], only_y: list[str]) -> bool:
    """Whether a word of one side carries a fact and is no slip, part or sum of the other's words."""
    for own, other in ((only_x, only_y), (only_y, only_x)):
        for w in own:
            if flat(w) not in STOP_WORDS and not any(slip(w, v) or w in v or v in w or _part(w, v) for v in other):
                return True
    return False


@lru_cache(1 << 13)
def _flats(text: str) -> frozenset[str]:
    return frozenset(map(flat, text.split(" ")))


def _apart(x: frozenset[str], y: frozenset[str]) -> bool:
    """Whether a word of one side that carries a fact has no counterpart on the other: a quick no."""
    if x == y:
        return False
    own, other = x - y, y - x
    like = lambda w, v: w in v or v in w or slip(w, v) or _part(w, v)
    alone = lambda w, near, all_: w not in STOP_WORDS and not any(like(w, v) for v in near) and not any(slip(w, v) for v in all_)
    return any(alone(w, other, y) for w in own) or any(alone(v, own, x) for v in other)


def _part(w: str, v: str) -> bool:
    """Whether two words may be pieces around a misplaced space: they share a beginning or an end."""
    return len(w) > 1 and len(v) > 1 and (w[:2] == v[:2] or w[-2:] == v[-2:])


def _half_accented(x: list[str], y: list[str]) -> bool:
    """Whether one side lost accents in a part of its words (names may keep theirs)."""
    bx, by = set(x), set(y)
    only_x, only_y = bx - by, by - bx
    if not only_x or not only_y:
        return False
    lost_x = {w for w in only_x if w.isascii()}
    lost_y = {w for w in only_y if w.isascii()}
    return len(lost_x) >= 0.6 * len(only_x) or len(lost_y) >= 0.6 * len(only_y)


def same_record(q1: list[str], a1: list[str], q2: list[str], a2: list[str], similarity: float = 0.75) -> bool:
    if not (q1 and q2 and a1 and a2):
        return False
    if q1 == q2 and a1 == a2:
        return True
    return jaccard(grams(q1, a1), grams(q2, a2)) >= similarity and same_words(a1, a2) and same_words(q1, q2)


# ---------------------------------------------------------------- Spark

#: Hashes a band and bands: within a picture, over texts alone (a pair of similarity 0.8 meets with probability 0.998,
#: one of 0.5 with 0.05), and within a crowded bucket.
NEAR, FAR, CROWDED = (3, 12), (10, 56), (6, 24)
#: Words of the bitmap of a text's 3-grams.
BITS = 8
_MADE: dict[str, _Minwise] = {}


def _minwise(kind: str, n: int, seed: int) -> _Minwise:
    if kind not in _MADE:
        _MADE[kind] = _Minwise(n, seed)
    return _MADE[kind]


def _normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        answers = [" ".join(normal_words(a)) for a in pdf["answer"]]
        yield pdf[["key", "picture", "none"]].assign(q=list(map(_question, pdf["question"])), a=answers, long=[len(look(a)) for a in pdf["answer"]])


# pandas would make floats of nullable numbers: no nulls go there
def _picture() -> list[Column]:
    return [F.coalesce("picture", F.lit(0).cast("bigint")).alias("picture"), F.col("picture").isNull().alias("none")]


def _picture_back() -> Column:
    return F.when(~F.col("none"), F.col("picture")).alias("picture")


def normal_records(df: DataFrame, least: int) -> DataFrame:
    """(key, picture, t0, t1, q, a, far): normal form of each record, 128 bits that stand for it, and
    whether the text alone may decide. Records with a null or wordless text are left out."""
    rows = df.where("key is not null and question is not null and answer is not null").select("key", *_picture(), "question", "answer")
    out = rows.mapInPandas(_normalised, "key bigint, picture bigint, none boolean, q string, a string, long int").where("q <> '' and a <> ''")
    return out.select("key", _picture_back(), F.xxhash64("q", "a").alias("t0"), F.xxhash64(F.lit(7), "a", "q").alias("t1"), "q", "a", (F.col("long") >= least).alias("far"))


def _bitmaps(hashes: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(hashes), BITS * 64), bool)
    for i, h in enumerate(hashes):
        out[i, h % (BITS * 64)] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text with its buckets (within the picture, or over texts alone where it is null), the number
    of its 3-grams and a bitmap of them."""
    m = _minwise("bands", max(NEAR[0] * NEAR[1], FAR[0] * FAR[1]), 1)
    for pdf in batches:
        if not len(pdf):
            continue
        words = [(q.split(" "), a.split(" ")) for q, a in zip(pdf["q"], pdf["a"])]
        least, plain = zip(*(m.of(grams(q, a)) for q, a in words))
        s = np.stack(least)
        number = np.array([_hash(digits(q)) << 32 | _hash(digits(a)) for q, a in words], np.uint64)
        near = ~pdf["none"].to_numpy(bool)
        scope = pd.util.hash_array(pdf["picture"].to_numpy(np.int64))
        buckets = np.empty(len(pdf), object)
        for at, key, (rows, n) in ((np.flatnonzero(near), number ^ scope, NEAR), (np.flatnonzero(~near), number, FAR)):
            for i, b in zip(at, _fold(key[at], s[at], rows, n)):
                buckets[i] = b
        bits = _bitmaps(plain)
        yield pdf.assign(n=[len(h) for h in plain], **{f"w{i}": bits[:, i] for i in range(BITS)}, buckets=buckets)


def _signed_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bands of further hashes under each crowded bucket."""
    m = _minwise("crowded", CROWDED[0] * CROWDED[1], 2)
    for pdf in batches:
        if len(pdf):
            s = np.stack([m.of(grams(q.split(" "), a.split(" ")))[0] for q, a in zip(pdf["q"], pdf["a"])])
            yield pdf[["t0", "picture", "none"]].assign(buckets=list(_fold(pdf["bucket"].to_numpy().view(np.uint64), s, *CROWDED)))


_ID = "t0 bigint, t1 bigint, picture bigint, none boolean"


def _signatures(own: DataFrame, other: DataFrame) -> DataFrame:
    """The texts of one side, once per picture that the other side has, and once without if it may decide alone."""
    pictures = other.where("picture is not null").select("picture").distinct()
    near = own.where("picture is not null").join(pictures, "picture", "left_semi").select("t0", "t1", "picture", "q", "a")
    far = own.where("far").select("t0", "t1", F.lit(None).cast("bigint").alias("picture"), "q", "a")
    rows = near.unionByName(far).distinct().select("t0", "t1", *_picture(), "q", "a")
    out = rows.mapInPandas(_signed, f"{_ID}, q string, a string, n int, {', '.join(f'w{i} bigint' for i in range(BITS))}, buckets array<bigint>")
    return out.withColumn("picture", _picture_back()).drop("none")


def _meet(t: DataFrame, v: DataFrame, salts: int = 1) -> DataFrame:
    """(picture, x0, y0): texts of both sides that share a bucket, once. Half of the bits of a text will do here:
    those that share them come along and are told apart afterwards."""
    a = t.select(F.col("picture").alias("_p"), "bucket", F.col("t0").alias("x0"))
    b = v.select("picture", F.col("bucket").alias("_b"), F.col("t0").alias("y0"))
    on = (F.col("bucket") == F.col("_b")) & F.col("_p").eqNullSafe(F.col("picture"))
    if salts > 1:
        a = a.withColumn("_s", F.pmod("x0", F.lit(salts)))
        b = b.withColumn("_z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        on = on & (F.col("_s") == F.col("_z"))
    return a.join(b, on).select("picture", "x0", "y0").distinct()


def _candidates(t: DataFrame, v: DataFrame, crowd: int, similarity: float) -> DataFrame:
    """Pairs of texts that share a bucket and may be similar enough; crowded buckets are split by further bands first."""
    bands = lambda df: df.select("t0", "picture", F.explode("buckets").alias("bucket"))
    bt, bv = bands(t), bands(v)
    full = lambda df: df.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("bucket")
    crowded = materialize(full(bt).unionByName(full(bv)).distinct(), "crowded")
    if crowded.isEmpty():
        met = _meet(bt, bv)
    else:
        own = lambda df: df.select("t0", *_picture(), "q", "a", F.explode("buckets").alias("bucket")).join(crowded, "bucket", "left_semi")
        again = lambda df: bands(own(df).mapInPandas(_signed_again, "t0 bigint, picture bigint, none boolean, buckets array<bigint>").withColumn("picture", _picture_back()))
        met = _meet(bt.join(crowded, "bucket", "left_anti"), bv.join(crowded, "bucket", "left_anti")).unionByName(_meet(again(t), again(v), 8)).distinct()
    # a bit that only one side has is an element that only one side has: an upper bound of the similarity
    words = range(BITS)
    a = t.select(F.col("picture").alias("_p"), F.col("t0").alias("x0"), F.col("t1").alias("x1"), F.col("n").alias("nx"), *(F.col(f"w{i}").alias(f"x_{i}") for i in words))
    b = v.select(F.col("picture").alias("_q"), F.col("t0").alias("y0"), F.col("t1").alias("y1"), *(F.col(f"w{i}").alias(f"y_{i}") for i in words))
    both = met.join(a, "x0").where(F.col("picture").eqNullSafe(F.col("_p"))).join(b, "y0").where(F.col("picture").eqNullSafe(F.col("_q")))
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}_{i}").bitwiseAND(F.bitwise_not(f"{q}_{i}"))) for i in words), F.lit(0))
    return both.where(F.col("nx") - only("x", "y") >= similarity * (F.col("nx") + only("y", "x"))).select("picture", "x0", "x1", "y0", "y1")


def _verified(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [
                not _apart(_flats(a1), _flats(a2)) and not _apart(_flats(q1), _flats(q2)) and same_record(q1.split(" "), a1.split(" "), q2.split(" "), a2.split(" "), similarity)
                for q1, a1, q2, a2 in zip(pdf["q1"], pdf["a1"], pdf["q2"], pdf["a2"])
            ]
            yield pdf.loc[ok, ["x0", "x1", "y0", "y1"]]

    return run


class Overlap:
    """What of ``held_out`` is in ``train``, both (key, picture, question, answer).

    ``similarity``: least Jaccard similarity of the 3-grams. ``least``: characters from which
    an answer may match without its picture. ``crowd``: texts of one side in a bucket from
    which it is split further.
    """

    def __init__(self, train: DataFrame, held_out: DataFrame, similarity: float = 0.75, least: int = 70, crowd: int = 1000):
        self.t = materialize(normal_records(train, least), "train")
        self.v = materialize(normal_records(held_out, least), "heldout")
        self.similarity, self.crowd = similarity, crowd

    @cached_property
    def found(self) -> DataFrame:
        """(picture, x0, x1, y0, y1): the candidates; without a picture where the texts alone brought them."""
        st, sv = materialize(_signatures(self.t, self.v), "tsigned"), materialize(_signatures(self.v, self.t), "vsigned")
        out = materialize(_candidates(st, sv, self.crowd, self.similarity), "candidates")
        for used in (st, sv):
            forget(used)
        return out

    @cached_property
    def texts(self) -> DataFrame:
        """(x0, x1, y0, y1): distinct texts of both sides that are the same or nearly so."""
        sides = [df.select(F.col("t0").alias(f"{c}0"), F.col("t1").alias(f"{c}1"), F.col("q").alias(f"q{i}"), F.col("a").alias(f"a{i}")).distinct() for i, (c, df) in enumerate((("x", self.t), ("y", self.v)), 1)]
        pairs = self.found.select("x0", "x1", "y0", "y1").distinct().join(sides[0], ["x0", "x1"]).join(sides[1], ["y0", "y1"])
        return materialize(pairs.mapInPandas(_verified(self.similarity), "x0 bigint, x1 bigint, y0 bigint, y1 bigint"), "verified")

    @cached_property
    def near(self) -> DataFrame:
        return self.found.where("picture is not null").join(self.texts, ["x0", "x1", "y0", "y1"], "left_semi")

    def _rows(self, t: DataFrame, v: DataFrame) -> DataFrame:
        """All pairs of rows; what decides is the text alone if both are long enough, else the picture too."""
        far = self.texts.join(t.where("tfar"), ["x0", "x1"]).join(v.where("vfar"), ["y0", "y1"])
        near = self.near.join(t.withColumnRenamed("tpicture", "picture"), ["picture", "x0", "x1"]).join(v.withColumnRenamed("vpicture", "picture"), ["picture", "y0", "y1"]).where("not (tfar and vfar)")
        return far.drop("tpicture", "vpicture").unionByName(near.drop("picture"))

    def _side(self, df: DataFrame, c: str, side: str, *more: str) -> DataFrame:
        return df.select(F.col("t0").alias(f"{c}0"), F.col("t1").alias(f"{c}1"), F.col("picture").alias(f"{side}picture"), F.col("far").alias(f"{side}far"), *more)

    def pairs(self) -> DataFrame:
        """(train_key, held_out_key): all pairs of rows that overlap."""
        t = self._side(self.t.withColumnRenamed("key", "train_key"), "x", "t", "train_key")
        v = self._side(self.v.withColumnRenamed("key", "held_out_key"), "y", "v", "held_out_key")
        return self._rows(t, v).select("train_key", "held_out_key")

    def members(self) -> DataFrame:
        """(side, key, class): the class of every row; rows of a class have equal normal forms and pictures.

        With :meth:`class_pairs` the whole result, without a row for each pair of copies.
        """
        one = lambda df, side: df.select(F.lit(side).alias("side"), "key", _class("t0", "t1", "picture", "far").alias("class"))
        return one(self.t, "train").unionByName(one(self.v, "held_out"))

    def class_pairs(self) -> DataFrame:
        """(train_class, held_out_class): classes whose rows overlap."""
        t, v = (self._side(df, c, s).distinct() for df, c, s in ((self.t, "x", "t"), (self.v, "y", "v")))
        t = t.withColumn("train_class", _class("x0", "x1", "tpicture", "tfar"))
        v = v.withColumn("held_out_class", _class("y0", "y1", "vpicture", "vfar"))
        return self._rows(t, v).select("train_class", "held_out_class")

    def report(self, held_out: DataFrame, key: str, by: list[str]) -> DataFrame:
        """Per ``by`` of the held-out records: overlapping pairs and held-out records, from counts of copies."""
        t = self._side(self.t, "x", "t").groupBy("x0", "x1", "tpicture", "tfar").agg(F.count("*").alias("n"))
        named = self.v.join(held_out.select(F.col(key).alias("key"), *by), "key")
        v = self._side(named, "y", "v", "key", *by)
        each = self._rows(t, v).groupBy("key", *by).agg(F.sum("n").alias("n"))
        return each.groupBy(*by).agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_records"))


def _class(*columns: str) -> Column:
    return F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), 256).substr(1, 32)


def overlaps(train: DataFrame, held_out: DataFrame, **options) -> DataFrame:
    """(train_key, held_out_key) from two tables (key, picture, question, answer); see :class:`Overlap`."""
    return Overlap(train, held_out, **options).pairs()
