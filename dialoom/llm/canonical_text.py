"""One consistent form for texts that look the same.

Method. A vocabulary of all tokens is counted over the whole corpus and kept in a trie.
Tokens written in an uncommon way run through it, as they are stored, as a weighted edit
automaton: a character that looks like the next one of a spelling costs nothing, and neither
does one that looks like nothing; marks may come in any order. The spelling accepted at cost
zero is the canonical one (if several, Latin letters first, then the most frequent, then the
smallest). Where none is, letters that most fonts draw alike (I and l, O and 0) cost nothing
either; so the vocabulary decides what no table of characters can. Tokens that nothing
accepts are normalised by the look-alike table. White space between tokens is normalised by
the table too and never merged.

Vocabulary entries are tokens in one script, in composed form and without ignorable
characters. Tokens are sharded by their look with the letters of the last step made equal, so
trie and tokens never meet across shards: a task holds one shard of the vocabulary, and shards
grow in number, not in size, with the vocabulary.

Nulls stay null. An empty text stays empty. A text of common characters only is returned
as it is and takes no part in any shuffle but the count of words; of the others, each distinct
text is rewritten once, and only its uncommon tokens are looked up. Repeated rows get equal
results. Very long texts are handled token by token, in time linear in them. Building a query
writes the distinct uncommon texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.lookalikes import PLAIN, TWINS, UNCOMMON, UNCOMMON_FAST, atoms, keep_joiners, look
from dialoom.session import materialize, shuffle_partitions

#: Characters between tokens. All of category Zs, tabs and line breaks.
_SPACES = " " + "\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000" + "\\t\\n\\r"
_TOKEN = regex.compile(f"[^{_SPACES}]+")
#: Java pattern: a token with an uncommon character.
_INNER = PLAIN.replace("\\t\\n\\r -~", "!-~")
ODD_TOKEN = f"(?<![^{_SPACES}])[{_INNER}]*+[^{PLAIN}{_SPACES}][^{_SPACES}]*+"
#: Java pattern: white space that looks like a plain space.
ODD_SPACE = f"[{_SPACES[1:].replace(chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r', '')}]"

_LATIN = regex.compile(r"\p{Latin}")
_OTHER = regex.compile(r"[^\P{L}\p{Latin}]")


def well_formed(token: str, rep: str) -> bool:
    """Whether a token may be a canonical spelling: one script, composed, nothing ignorable."""
    if token == rep:
        return not (_LATIN.search(token) and _OTHER.search(token))
    return not _LATIN.search(token) and all(c in TWINS or unicodedata.normalize("NFC", atoms(c)) == c for c in token)


#: Letters that most fonts draw alike. They count as equal only where nothing else is found.
FONT_TWINS = {"I": "l", "0": "O"}
_FOLD = str.maketrans(FONT_TWINS)


@lru_cache(1 << 12)
def _shapes(c: str) -> tuple[str, ...]:
    """The letters and marks that one stored character shows, none if it is ignorable."""
    return tuple(atoms(c))


class Trie:
    """A trie of spellings, searched by a weighted edit automaton.

    Weights: a stored character against the characters of a spelling that it looks like costs 0, and
    so does dropping one that looks like nothing; with ``fonts`` so do letters that most fonts draw
    alike. Every other substitution, insertion or deletion costs 1.
    """

    def __init__(self, spellings: Iterable[tuple[str, int]] = ()):
        self.root: dict = {}
        for s, n in spellings:
            self.add(s, n)

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for a in unicodedata.normalize("NFD", spelling):
            node = node.setdefault(a, {})
        node.setdefault("", []).append((spelling, count))

    def search(self, token: str, most: int = 0, fonts: bool = False) -> list[tuple[int, str, int]]:
        """All spellings within cost ``most`` of the token as stored, as (cost, spelling, count)."""
        # a state: the node reached, and the marks read since the last letter that no edge has taken yet
        states: dict[tuple[int, str], tuple[int, dict]] = {(id(self.root), ""): (0, self.root)}
        for c in keep_joiners(token):
            for r in _shapes(c):
                mark = unicodedata.combining(r) > 0
                after: dict[tuple[int, str], tuple[int, dict]] = {}

                def reach(cost: int, node: dict, waiting: str, after=after) -> None:
                    key = (id(node), waiting)
                    if cost <= most and (key not in after or after[key][0] > cost):
                        after[key] = (cost, node)

                for (_, waiting), (cost, node) in states.items():
                    if mark:
                        self._marks(cost, node, "".join(sorted(waiting + r)), reach)
                    elif waiting:
                        if cost + len(waiting) > most:
                            continue
                        cost += len(waiting)
                    for a, child in self._edges(node, r, most):
                        same = a == r or _shapes(a) == (r,) or fonts and a.translate(_FOLD) == r.translate(_FOLD)
                        if not mark or not same:
                            reach(cost + (not same), child, waiting if mark else "")
                    if most:
                        reach(cost + 1, node, waiting if mark else "")  # a character of the token is dropped
                if most:
                    todo = list(after.items())
                    while todo:  # a character of the spelling is skipped
                        (_, waiting), (cost, node) = todo.pop()
                        for a, child in node.items():
                            key = (id(child), waiting)
                            if a and cost + 1 <= most and (key not in after or after[key][0] > cost + 1):
                                after[key] = (cost + 1, child)
                                todo.append((key, after[key]))
                states = after
                if not states:
                    return []
        best: dict[str, tuple[int, str, int]] = {}
        for (_, waiting), (cost, node) in states.items():
            for s, n in node.get("", ()):
                if cost + len(waiting) <= most and (s not in best or best[s][0] > cost + len(waiting)):
                    best[s] = (cost + len(waiting), s, n)
        return list(best.values())

    @staticmethod
    def _edges(node: dict, r: str, most: int) -> list[tuple[str, dict]]:
        return [(a, child) for a, child in node.items() if a]

    @staticmethod
    def _marks(cost: int, node: dict, waiting: str, reach) -> None:
        """Marks leave in whatever order the spelling has them."""
        todo = [(node, waiting)]
        while todo:
            node, waiting = todo.pop()
            reach(cost, node, waiting)
            for i, r in enumerate(waiting):
                if r in node and waiting.find(r) == i:
                    todo.append((node[r], waiting[:i] + waiting[i + 1 :]))


def canonical_spelling(trie: Trie, token: str) -> str:
    """The best spelling at cost zero, else the table's form."""
    for fonts in (False, True):
        found = [(not _LATIN.search(s) and bool(_OTHER.search(s)), -n, s) for _, s, n in trie.search(token, fonts=fonts)]
        if found:
            return min(found)[2]
    return look(token)


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: (rep, token, n, odd) of every token, rep being its folded look; odd ones are to be looked up."""
    for pdf in batches:
        seen: Counter = Counter()
        for text in pdf["text"]:
            if text is not None:
                seen.update(text.split(" ") if text.isascii() else _TOKEN.findall(text))
        seen.pop("", None)
        toks = list(seen)
        reps = [look(t) for t in toks]
        odd = [_ODD.search(t) is not None for t in toks]
        keep = [o or _ASCII_ALNUM.search(r) is not None for o, r in zip(odd, reps)]
        yield pd.DataFrame({"rep": [r.translate(_FOLD) for r, k in zip(reps, keep) if k], "token": [t for t, k in zip(toks, keep) if k], "n": [seen[t] for t, k in zip(toks, keep) if k], "odd": [o for o, k in zip(odd, keep) if k]})


_ODD = regex.compile(UNCOMMON)
_ASCII_ALNUM = regex.compile(r"[\p{L}\p{N}]")


def _match(_: tuple, words: pd.DataFrame) -> pd.DataFrame:
    """One shard: build the trie of its well-formed spellings, look its odd tokens up."""
    trie = Trie((t, n) for t, n in zip(words["token"], words["n"]) if well_formed(t, look(t)))
    odd = words[words["odd"]]
    return pd.DataFrame({"token": odd["token"], "spelling": [canonical_spelling(trie, t) for t in odd["token"]]})


def spellings(texts: DataFrame) -> DataFrame:
    """(token, spelling) for each oddly written token of ``texts`` (column ``text``).

    The vocabulary is counted in batches, then by token. Only vocabulary entries that share
    their representative with an odd token go on to the shards.
    """
    counted = texts.select("text").mapInPandas(_count_tokens, "rep string, token string, n bigint, odd boolean")
    # one shuffle by representative serves the counts and the question which ones are wanted
    words = counted.repartition("rep").groupBy("rep", "token").agg(F.sum("n").alias("n"), F.max("odd").alias("odd"))
    near = words.withColumn("wanted", F.max("odd").over(Window.partitionBy("rep"))).where("wanted").drop("wanted")
    shards = 8 * shuffle_partitions(texts.sparkSession)
    return near.groupBy(F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard")).applyInPandas(_match, "token string, spelling string")


def uncommon(c: Column | str) -> Column:
    """Whether a text has a character that may be written otherwise; JVM only."""
    return F.rlike(F.col(c) if isinstance(c, str) else c, F.lit(UNCOMMON_FAST))


def digests(c: Column | str, name: str) -> list[Column]:
    """128 bits that stand for a text, in two columns."""
    return [F.xxhash64(c).alias(f"{name}0"), F.xxhash64(F.lit(7), c).alias(f"{name}1")]


def odd_forms(odd: DataFrame, texts: DataFrame) -> DataFrame:
    """(_t0, _t1, form): the consistent form of each distinct text of ``odd`` (_t0, _t1, text), all with
    uncommon characters; ``texts`` (text) is the corpus that the vocabulary comes from."""
    odd = odd.groupBy("_t0", "_t1").agg(F.regexp_replace(F.first("text"), ODD_SPACE, " ").alias("text"))
    odd = materialize(odd, "odd")
    tokens = odd.select("_t0", "_t1", F.posexplode(F.regexp_extract_all("text", F.lit(ODD_TOKEN), F.lit(0))).alias("i", "token"))
    spelled = tokens.join(spellings(texts), "token", "left").groupBy("_t0", "_t1").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("spelling", "token").alias("s")))), lambda x: x.s).alias("s"))
    # what stands between the uncommon tokens, and the spellings, in turn
    between = F.split("text", ODD_TOKEN, -1)
    form = F.array_join(F.flatten(F.zip_with(between, F.coalesce("s", F.array().cast("array<string>")), lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "")
    return odd.join(spelled, ["_t0", "_t1"], "left").select("_t0", "_t1", form.alias("form"))


def canonical(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """Add ``out``, the consistent form of ``column``; texts of common characters pass unchanged."""
    base = df.drop(out) if out in df.columns else df
    common = base.where(~F.coalesce(uncommon(column), F.lit(False))).withColumn(out, F.col(column))
    clash = {c: c + "_" for c in base.columns if c in ("_t0", "_t1")}
    texts = df.select(F.col(column).alias("text"))
    forms = odd_forms(texts.where(uncommon("text")).select(*digests("text", "_t"), "text"), texts).withColumnRenamed("form", out)
    rest = base.withColumnsRenamed(clash).where(uncommon(column)).select("*", *digests(column, "_t")).join(forms, ["_t0", "_t1"])
    back = {v: k for k, v in clash.items()}
    return common.unionByName(rest.drop("_t0", "_t1").withColumnsRenamed(back).select(*common.columns))


LETTERS_AND_DIGITS = r"[^\p{L}\p{N}]"


def same_look(df: DataFrame, column: str, key: str, by: list[str], least: int = 40, salts: int = 8) -> DataFrame:
    """(by, key_a, key_b): rows of one ``by`` whose texts look the same, stored differently.

    Each pair has an oddly written side, so only those few forms are salted and sent to the
    rows of the same look; 128 bits of hash stand for a text, texts themselves don't move.
    A hot text is spread over ``salts`` tasks and further by skew-join splitting.
    """
    rows = df.select(*by, F.col(key).alias("_key"), F.col(column).alias("_text")).where(F.col("_text").isNotNull())
    # one pass over the texts keeps their digests, and the texts only where they are uncommon
    stored = materialize(rows.select(*by, "_key", *digests("_text", "_t"), F.when(uncommon("_text"), F.col("_text")).alias("text")), "stored")
    forms = materialize(odd_forms(stored.where("text is not null").select("_t0", "_t1", "text"), rows.select(F.col("_text").alias("text"))).select("_t0", "_t1", *digests("form", "_f"), (F.length(F.regexp_replace("form", LETTERS_AND_DIGITS, "")) >= least).alias("_long")), "forms")
    odd = stored.where("text is not null").drop("text").join(forms, ["_t0", "_t1"])
    own = [*by, "_key", "_t0", "_t1", "_f0", "_f1"]
    every = stored.where("text is null").withColumns({"_f0": F.col("_t0"), "_f1": F.col("_t1")}).select(*own).unionByName(odd.select(*own))
    left = odd.where("_long and (_t0 <> _f0 or _t1 <> _f1)")
    left = left.select(*by, F.col("_key").alias("_a"), F.col("_t0").alias("_a0"), F.col("_t1").alias("_a1"), "_f0", "_f1", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    right = every.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
    pairs = left.join(right, [*by, "_f0", "_f1", "_salt"]).where("_t0 <> _a0 or _t1 <> _a1")
    # where both sides are odd the pair comes from both: keep it from its smaller key
    other_odd = (F.col("_t0") != F.col("_f0")) | (F.col("_t1") != F.col("_f1"))
    pairs = pairs.where(~other_odd | (F.col("_a") < F.col("_key")))
    return pairs.select(*by, F.least("_a", "_key").alias("key_a"), F.greatest("_a", "_key").alias("key_b"))
