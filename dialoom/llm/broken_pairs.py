"""Defective question-answer pairs.

Each pair gets the first defect that applies, of ``empty``, ``copies_question``,
``refusal``, ``other_language`` and ``truncated``; a sound pair gets null. All tests work
on the look of a text (see ``lookalikes``), without letter case where case means nothing.

* ``empty``: null, nothing but blank, invisible, punctuation or symbol characters, or a
  filler for a missing answer.
* ``copies_question``: greedy string tiling covers the answer with runs of the question, however
  often they are repeated, and the pieces cover what the question asks. (An answer that repeats only a name out of
  the question's preamble is an answer.)
* ``refusal``: a sentence outside quotations that the refusal grammar derives.
* ``other_language``: script, then - for Latin script - whether the words outside names
  and quotations are built like Vietnamese syllables, then the commonest function words.
* ``truncated``: a pushdown parser over fences, code, formulas, brackets, quotations, emphasis,
  markup, lists and tables ends with something open; or the text ends in a separator, a list marker, a word that wants another
  one, or a piece of a word. Pieces of words are learned from all answers: a short final
  word that in the whole corpus stands mostly at open ends and begins longer, commoner words.

Nulls: a null question makes no pair, a null answer is empty. Very long texts are parsed,
tiled and read in linear passes over the whole text. Repeated rows get
equal defects. No rows give no rows. Extra columns of any name are carried along untouched.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dialoom.llm.lookalikes import look as any_look
from dialoom.llm.lookalikes import no_accents
from dialoom.session import materialize

@lru_cache(8)
def look(text: str) -> str:
    """The tests of one pair share its looks."""
    return any_look(text)


@lru_cache(8)
def folded(seen: str) -> str:
    """Without accents and case; apostrophes go."""
    return no_accents(seen).casefold().replace("'", "").replace("’", "")


# ---------------------------------------------------------------- empty

# What is written in place of a missing answer, without accents and case.
FILLERS = frozenset(
    [
        "n a", "na", "none", "null", "nil", "nan", "empty", "blank", "missing", "undefined", "unknown", "tbd", "todo", "no answer", "no response", "no content", "not available", "not applicable", "not answered", "answer missing", "no answer given", "no reply", "void",
        "trong", "bo trong", "de trong", "rong", "trong rong", "khong co cau tra loi", "khong co tra loi", "khong co dap an", "khong co noi dung", "khong co du lieu", "chua co cau tra loi", "chua co dap an", "chua tra loi", "chua co noi dung", "chua co du lieu", "chua co", "khong tra loi", "thieu cau tra loi", "cau tra loi trong", "dang cap nhat", "chua cap nhat", "cap nhat sau", "khong co thong tin tra loi", "answer", "cau tra loi", "tra loi", "dap",
    ]
)

_LETTER = regex.compile(r"[\p{L}\p{N}]")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)?")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    seen = look(answer)
    if not _LETTER.search(seen):
        return True
    if flat_word(_WORDS.search(seen)[0]) not in _FILLER_STARTS:
        return False
    first = [m[0] for m, _ in zip(_WORDS.finditer(seen), range(_LONGEST_FILLER + 1))]
    return len(first) <= _LONGEST_FILLER and " ".join(map(flat_word, first)) in FILLERS


_FILLER_STARTS = frozenset(f.split(" ")[0] for f in FILLERS)
_LONGEST_FILLER = max(len(f.split(" ")) for f in FILLERS)


# ---------------------------------------------------------------- copies of the question

# Labels put before a repeated question.
LABELS = (("cau", "hoi"), ("hoi",), ("question",), ("q",), ("ban", "hoi"), ("nguoi", "dung", "hoi"), ("user",), ("human",))


@lru_cache(1 << 16)
def flat_word(word: str) -> str:
    return no_accents(word).casefold()


@lru_cache(8)
def words_of(seen: str) -> tuple[str, ...]:
    return tuple(_WORDS.findall(seen))


def tokens(text: str) -> list[str]:
    return list(map(flat_word, words_of(look(text))))


class _Runs:
    """All runs of tokens of a question, as a suffix automaton."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.last_end = [-1], [0], [-1]
        last = 0
        for j, w in enumerate(tokens):
            new = self._state({}, self.size[last] + 1, j)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.next[q]), self.size[p] + 1, j)
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new
        # the last place at which each state's runs end
        for x in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[x]
            self.last_end[p] = max(self.last_end[p], self.last_end[x])

    def _state(self, after: dict[str, int], size: int, end: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(-1)
        self.last_end.append(end)
        return len(self.size) - 1


def tiles(runs: _Runs, text: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in the question, start in the text, length) of runs that cover the text.

    From the end of the text, each tile is the longest run that the question has; it may be there
    several times. Linear in the text: lengths of the longest runs come from one pass through the
    automaton.
    """
    length, end = [], []
    state = n = 0
    for w in text:
        while state and w not in runs.next[state]:
            state = runs.link[state]
            n = runs.size[state]
        if w in runs.next[state]:
            state, n = runs.next[state][w], n + 1
        length.append(n)
        end.append(runs.last_end[state] if n else -1)
    out, j = [], len(text) - 1
    while j >= 0:
        k = length[j]
        if k >= least:
            out.append((end[j] - k + 1, j - k + 1, k))
            j -= k
        else:
            j -= 1
    return out


@lru_cache(1 << 13)
def _asked(question: str) -> tuple[list[str], frozenset[str], _Runs, int]:
    """Tokens of a question, all their runs, and how many of the last ones are the asking clause."""
    q = tokens(question)
    return q, frozenset(q), _Runs(q), len(tokens(_CLAUSE.split(look(question).rstrip(" :,"))[-1]))


_CLAUSE = regex.compile(r"[:：,，]\s*")


def copies_question(question: str, answer: str) -> bool:
    q, known, runs, core = _asked(question)
    a = tokens(answer)
    for label in LABELS:
        if tuple(a[: len(label)]) == label and tuple(q[: len(label)]) != label:
            a = a[len(label) :]
            break
    if not a or not q or sum(map(known.__contains__, a)) < 0.9 * len(a):
        return False
    found = tiles(runs, a, min(2, len(q), len(a)))
    asked = {x for i, k in {(i, k) for i, _, k in found} for x in range(max(i, len(q) - core), i + k)}
    return len(a) - sum(k for _, _, k in found) <= 0.1 * len(a) and len(asked) >= 0.8 * core


# ---------------------------------------------------------------- refusals

_QUOTED = regex.compile(r"[\"“”„‟][^\"“”„‟]*(?:[\"“”„‟]|$)|«[^»]*(?:»|$)|‘[^’]*’|「[^」]*(?:」|$)|『[^』]*(?:』|$)|`[^`]*(?:`|$)")


_MARKS = regex.compile(r"[\"“”„‟«‘「『`]")


@lru_cache(8)
def outside_quotes(seen: str) -> str:
    """The text without quotations, unless the whole text is one (then the marks say nothing)."""
    bare = _QUOTED.sub(" ", seen) if _MARKS.search(seen) else seen
    bare = _REPORT.sub(" ", bare) if ":" in bare else bare
    return bare if _LETTER.search(bare) else ""


# Words that announce what a sign says: the rest of the line is its text.
_REPORT = regex.compile(r"\b(?:ghi|viết|đề|chữ|dòng|rằng|nội dung|thông báo|biển|bảng)(?:\s+(?:là|rằng))?\s*:.*", regex.I)

# The terminals of the Vietnamese refusal grammar and the words they derive, without
# accents and case ("baan" and "chuwa": see _ACCENTED). A refusal is an act of the speaker.
TERMINALS = {
    "S": "toi|minh|em|to|chung toi|chung minh|chung em|ben minh|tro ly|tro ly ai|mo hinh|mo hinh ngon ngu|he thong|ai",
    "N": "khong|chuwa|chang",
    "M": "the|duoc phep|duoc quyen|duoc|the nao|co the|co kha nang|co quyen|du kha nang|biet cach|muon|dam|tien",
    "A": "tra loi|thuc hien|dap ung|giup|giup do|ho tro|xem|nhin|nhin thay|doc|mo ta|xac dinh|nhan dien|nhan xet|nhan dinh|binh luan|danh gia|cung cap|dua ra|baan|baan ve|noi|noi ve|chia se|tiet lo|xu ly|phan tich|truy cap|dich|giai dap|tu van|tiep tuc|lam dieu|lam viec|doan",
    "D": "tu choi|xin kieu|xin bo qua|xin duoc bo qua|xin phep bo qua|xin tu choi|xin duoc tu choi|xin phep tu choi|xin khong|xin phep khong|xin phep duoc khong|xin phep",
    "K": "biet|ro|chac|hieu|nhin ro|doc ro|thay ro|du thong tin|du du lieu|du co so|co du|co thong tin|co du lieu",
    "G": "chiu|chiu thua|chiu chet|bo tay|dau hang|bat luc",
    "B": "vi pham|trai voi|trai|phu hop|an toan",
    "P": "quy dinh|cac quy dinh|chinh sach|cac chinh sach|nguyen tac|tieu chuan|dieu khoan",
    "O": "ngoai|nam ngoai|vuot qua|vuot ngoai|thuoc|nam trong",
    "R": "pham vi|kha nang|tham quyen",
    "V": "de",
    "T": "cua hang|quan|tiem|nha hang|sieu thi|khach|khach hang|quy khach|chu quan|nhan vien|bien|bang hieu|tam bien|thong bao|to giay|nguoi|xe",
    "c": "hay|nhi|nen|nhung|vi|do",
}
#: Productions, as regular expressions over terminals ("w": any other word, "d": duoc).
# cannot, may not act / acts not with success / declines / lacks what it takes / gives up / against or beyond what it may
_FREE = regex.compile(r"NMw?A|NAM|D(?:[wc]?A|N|$|w|,)|NKV[wMN]?A|NB?V?A?(?<=BVA)|(?<!N)BP|O[w]?R")
_SPOKEN = regex.compile(r"S[wc]{0,2}(?:NM|NK|[wNM]{0,1}G|D)|SN(?=A)")
_BY_WORD: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _symbol, _phrases in TERMINALS.items():
    for _phrase in _phrases.split("|"):
        _ws = tuple(_phrase.split(" "))
        _BY_WORD.setdefault(_ws[0], []).append((_ws, _symbol))
for _list in _BY_WORD.values():
    _list.sort(key=lambda x: -len(x[0]))


def parse_terms(words: list[str]) -> str:
    """Terminals of a sentence, the longest phrase first."""
    out, i = [], 0
    while i < len(words):
        for ws, symbol in _BY_WORD.get(words[i], ()):
            if tuple(words[i : i + len(ws)]) == ws:
                # a child, a schoolgirl: no speaker
                if ws == ("em",) and words[i + 1 : i + 2] and words[i + 1] in ("be", "hoc", "gai", "trai", "nho"):
                    symbol = "T"
                out.append(symbol)
                i += len(ws)
                break
        else:
            out.append("," if words[i] == "," else "w")
            i += 1
    return "".join(out)


def derives_refusal(terms: str) -> bool:
    """Whether the grammar derives a refusal from a part of the sentence.

    What has no speaker of its own is the speaker's unless a shop, a sign or a guest is the subject
    of its clause.
    """
    if _SPOKEN.search(terms):
        return True
    for m in _FREE.finditer(terms):
        left = regex.split("[,c]", terms[: m.start()])[-1]
        if "T" not in left or left.rfind("S") > left.rfind("T"):
            return True
    return False


_ME = r"(?:i|we|this assistant|the assistant|the model)"
_NOT = r"(?:can ?not|cant|can not|could not|couldnt|am unable to|are unable to|unable to|am not able to|are not able to|wont|will not|am not allowed to|am not permitted to|must decline|have to decline|decline to|refuse to|must refuse|would rather not|prefer not to|do not have the ability|dont have the ability|am not going to|do not feel comfortable|dont feel comfortable|am not comfortable|lack the ability)"
_EN = [
    rf"\b{_ME} (?:\w+ )?{_NOT}\b",
    r"\bas an ai\b|\bas a language model\b|\bas an assistant i\b",
    r"\b(?:sorry|apologi[sz]e)\b.{0,40}\b(?:cant|can ?not|unable|not able|wont|not allowed)\b",
    r"\b(?:against|violates?) (?:my|our|the) (?:policy|policies|guidelines|rules)\b",
    r"^(?:unable to|not able to|cannot|cant) (?:answer|help|assist|comply|view|see|read|describe|process|provide)\b",
    r"\boutside (?:of )?(?:my|the) (?:scope|capabilities)\b",
]
_OTHER = [
    r"\bje ne (?:peux|puis|suis pas)\b|\bje refuse\b|\bje suis (?:desole|incapable)\b|\bimpossible de repondre\b",
    r"\blo siento\b.{0,40}\bno\b|\bno puedo (?:responder|ayudar|ver|contestar|describir|hacer|comentar|leer)\b|\bno me es posible\b",
    r"\bich kann\b.{0,60}\bnicht\b|\btut mir leid\b|\bich darf\b.{0,60}\bnicht\b|\bkann ich (?:leider )?nicht\b",
    r"\b(?:saya|kami) (?:tidak|belum) (?:dapat|bisa|mampu|boleh)\b|\bmaaf\b.{0,40}\btidak\b",
    r"\bnao posso (?:responder|ajudar)\b|\bnon posso (?:rispondere|aiutar)\w*\b",
    r"(?:я )?(?:не могу|не имею возможности|отказываюсь|не в состоянии)|(?:извините|простите|к сожалению).{0,40}не (?:могу|можем)",
    r"(?:抱歉|对不起|對不起|很遗憾|很遺憾).{0,20}(?:无法|無法|不能|没法)|我(?:无法|無法|不能)|(?:无法|無法)(?:回答|提供|协助|查看)|拒绝回答",
    r"申し訳.{0,30}(?:できません|できない|かねます)|お答えできません|答えることができません|回答できません|お手伝いできません",
    r"(?:죄송|미안).{0,30}(?:없습니다|못합니다|어렵습니다)|(?:답변|대답|도와)\w*\s?(?:할|드릴) 수 없",
    r"(?:ขออภัย|ขอโทษ).{0,40}ไม่|ไม่สามารถ(?:ตอบ|ช่วย|ดู|ให้)",
]
_REFUSAL = regex.compile("|".join(f"(?:{p})" for p in _EN))
_REFUSAL_RAW = regex.compile("|".join(f"(?:{p})" for p in _OTHER))
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|\n+")


_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_LETTER_RUN = regex.compile(r"\p{L}+")
_CYRILLIC_BACK = str.maketrans("aceopxyiABCEHKMOPTXY", "асеорхуіАВСЕНКМОРТХУ")


def native(seen: str) -> str:
    """Undo the Latin twins inside words that have a letter of Cyrillic only."""
    if not _CYRILLIC.search(seen):
        return seen
    fixed = _LETTER_RUN.sub(lambda m: m[0].translate(_CYRILLIC_BACK) if _CYRILLIC.search(m[0]) else m[0], seen)
    # short words made of twins only belong to the script around them
    return regex.sub(r"(?<=\p{Cyrillic}\p{P}?\s)[aceopxyiABCEHKMOPTXY]{1,3}(?=[\s\p{P}])|^[aceopxyiABCEHKMOPTXY]{1,3}(?=\s\p{Cyrillic})", lambda m: m[0].translate(_CYRILLIC_BACK), fixed)


# words whose accents decide: to discuss, not to sell; not yet, not sour
_ACCENTED = {"bàn": "baan", "chưa": "chuwa"}
# what each grammar can't do without
_HINT = ("khong", "chua", "chang", "tu choi", "xin ", "vi pham", "trai ", "pham vi", "chiu", "bo tay", "dau hang", "bat luc", "ngoai", "vuot")
_HINT_EN = ("not", "cant", "wont", "unable", "decline", "refuse", "sorry", "apolog", "as an", "as a lang", "against", "violate", "outside", "lack")
_HINT_OTHER = ("je ", "impossible", "lo siento", "no puedo", "no me es", "ich ", "tut mir", "kann ich", "saya", "kami", "maaf", "nao posso", "non posso")
_UNACCENTED = regex.compile(r"(?<=\b(?:toi|minh|em) )chua\b|\bban(?= ve\b)")
_CLAUSES = regex.compile(r"[\p{L}\p{N}]+|[,;:()–—]")


def flat(seen: str) -> str:
    """Words without accents, case and punctuation, single-spaced; sentences on their own lines; commas
    and what else parts clauses stay. Names (capitals inside a sentence) are written as x."""
    lines = []
    for s in _SENTENCE.split(seen):
        ws = _CLAUSES.findall(s.replace("'", "").replace("’", ""))
        shouting = s.upper() == s
        named = lambda i, w: i and w[0].isupper() and not shouting and w not in ("AI", "I")
        lines.append(" ".join("," if not w[0].isalnum() else "x" if named(i, w) else _ACCENTED.get(w.casefold(), flat_word(w)) for i, w in enumerate(ws)))
    out = "\n".join(lines)
    return _UNACCENTED.sub(lambda m: "chuwa" if m[0] == "chua" else "baan", out) if "chua" in out or "ban ve" in out else out


def is_refusal(answer: str) -> bool:
    seen = outside_quotes(look(answer))
    if not seen:
        return False
    plain = folded(seen)
    if any(map(plain.__contains__, _HINT)) and any(derives_refusal(parse_terms(line.split(" "))) for line in flat(seen).split("\n")):
        return True
    if any(map(plain.__contains__, _HINT_EN)) and _REFUSAL.search(" ".join(_LETTERS.findall(plain))):
        return True
    if any(map(plain.__contains__, _HINT_OTHER)) and _REFUSAL_RAW.search(plain):
        return True
    return _NON_LATIN.search(seen) is not None and _REFUSAL_RAW.search(native(seen).casefold()) is not None


_LETTERS = regex.compile(r"[\p{L}\p{N}]+")


# ---------------------------------------------------------------- language

# The parts of a Vietnamese syllable, without accents.
_ONSET = r"(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|b|c|d|g|h|k|l|m|n|p|r|s|t|v|x)?"
_RHYME = r"(?:a(?:ch|ng|nh|[cimnoptuy])?|e(?:ch|ng|nh|[cmnopt])?|i(?:a|u|ch|nh|[cmnpt]|e(?:ng|[cmnptu]))?|o(?:a(?:ng|ch|nh|[cimnptyo])?|e(?:[nto])?|i|o(?:ng|c)|ng|[cmnpt])?|u(?:a|o(?:ng|[cimnptu])|e(?:ch|nh|[nt])?|y(?:a|e(?:n|t)|nh|ch|[ntpu])?|i|u|a(?:ng|[nty])|ng|[cmnpt])?|y(?:e(?:ng|[mntu])|[mnt])?)"
_SYLLABLE = regex.compile(_ONSET + _RHYME)

# Frequent words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the a an is are was were it this that they there you i in on at of to and with for from what where how many does do has have by not above",
    "fr": "le la les un une des du de est sont c'est il elle ce cette dans sur au aux et avec pour qui que",
    "es": "el la los las un una es son esta este en de del y con para que se hay",
    "de": "der die das ein eine ist sind an auf in dem den von mit und fur zu uber nicht",
    "id": "ini itu adalah sebuah di ke dari dan yang dengan untuk ada tidak pada",
    "pt": "o a os as um uma e sao em de do da no na com para que ha",
    "it": "il lo la i gli le un una e sono in di del della con per che",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SCRIPTS = {"zh": r"\p{Han}", "ja": r"[\p{Hiragana}\p{Katakana}]", "ko": r"\p{Hangul}", "th": r"\p{Thai}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "hi": r"\p{Devanagari}", "km": r"\p{Khmer}", "lo": r"\p{Lao}", "el": r"\p{Greek}", "he": r"\p{Hebrew}"}
_SCRIPT = {k: regex.compile(v) for k, v in _SCRIPTS.items()}
_NON_LATIN = regex.compile(r"[^\P{L}\p{Latin}]")
_NON_LATIN_RUN = regex.compile(r"[^\P{L}\p{Latin}]+")
_UPPER = regex.compile(r"\p{Uppercase}")
_LATIN_WORD = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*")


def _like_vietnamese(flat: str) -> bool:
    return _SYLLABLE.fullmatch(flat) is not None



@lru_cache(1 << 16)
def _kind(word: str) -> tuple[str, str, str, bool]:
    """(kind of the first character, word, flat form, whether it is built like a Vietnamese syllable)"""
    c, low = word[0], flat_word(word).replace("’", "'")
    return "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other", word, low, _like_vietnamese(low)


def language(text: str) -> str | None:
    """A language code, ``"latin"`` for foreign text of an unclear language, null without evidence."""
    seen = native(outside_quotes(look(text)))
    foreign = _NON_LATIN.findall(seen)
    if foreign:
        latin = sum(1 for w in _LATIN_WORD.findall(seen) if w[0].islower())
        if len(foreign) >= 2 and (len(foreign) > 4 * latin or len(_NON_LATIN_RUN.findall(seen)) > latin):
            counts = {k: len(p.findall(seen)) for k, p in _SCRIPT.items()}
            best = max(counts, key=counts.get)
            return "ja" if counts["ja"] else best if counts[best] else "other"
    kinds = [k for k in map(_kind, words_of(seen)) if k[0] != "digit"]
    ws = [k[1] for k in kinds]
    capitals = sum(k[0] == "upper" for k in kinds)
    shouting = capitals > 0 and len(_UPPER.findall(seen)) > 0.4 * sum(map(len, ws))
    title = not shouting and len(ws) >= 4 and capitals >= 0.9 * len(ws)
    kept = kinds if shouting or title else [k for i, k in enumerate(kinds) if k[0] == "lower" or (i == 0 and len(ws) > 1)]
    if len(kept) > 1 and seen.rstrip().endswith(kept[-1][1]):
        kept = kept[:-1]  # an open end may hold a piece of a word
    if not kept or not title and not shouting and capitals == len(ws):
        return None  # names only
    good = sum(k[3] for k in kept)
    if good == len(kept):
        return "vi"
    flats, kept = [k[2] for k in kept], [k[1] for k in kept]
    guess = {k: sum(f in v for f in flats) for k, v in _FUNCTION.items()}
    best = max(guess, key=guess.get)
    if good >= 0.75 * len(flats):
        return best if all(map(str.isascii, kept)) and len(flats) >= 3 and guess[best] >= 0.6 * len(flats) else "vi"
    return best if guess[best] else "latin"


_language = lru_cache(1 << 14)(language)  # questions recur

# Function words of Vietnamese; not those that stand before an address.
_VI_FUNCTION = frozenset("có là đây một không màu và của với trong trên từ đến được cho các những lúc này đang co la day khong mau va cua voi tu den".split())


def other_language(question: str, answer: str, lang: str | None = "") -> bool:
    a = lang if lang != "" else language(answer)
    if a is None:
        return False
    q = _language(question)
    if q is None or q == a or "latin" in (q, a) and "vi" not in (q, a) and (q in _FUNCTION or a in _FUNCTION or q == a):
        return False
    if a == "vi":  # a bare name, address or number answers a foreign question, too
        ws = words_of(outside_quotes(look(answer)))
        return any(w.casefold() in _VI_FUNCTION for w in ws) or sum(1 for w in ws if w[0].islower()) >= 3
    return True


# ---------------------------------------------------------------- truncation

_STRAIGHT = str.maketrans("“”„‟", '""""')
_PAIRED = regex.compile(r"[\"“”„‟()\[\]{}«»「」『』（）【】《》<`*_~$|]|\n")
_OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_TICKS = regex.compile(r"`+")
_STRONG = regex.compile(r"\*{1,3}|_{2,3}|~~")
_ITEM = regex.compile(r"[ \t]*(?:[-*•+]|\d{1,3}[.)]|[a-z]\))(?:[ \t]+|$)")
_ROW = regex.compile(r"[ \t]*\|.*\|[ \t]*")


def left_open(seen: str) -> bool:
    """Pushdown parser: whether a construct is open at the end.

    Parsed are fences, inline code, formulas ($$), brackets, quotations, emphasis, markup elements, list
    items and table rows. A straight quote opens where none is open and closes where one is; inside a
    quotation brackets are parsed on, inside code and formulas nothing is. A closing bracket without an
    opening one (as in "a)" lists) is skipped; one that closes an outer bracket drops what was open
    inside it, unless that was a quotation. Emphasis opens before a word and closes after one, and ends
    with its paragraph. A list item is open until it has content, a row of a table until its last bar.
    """
    if not _PAIRED.search(seen):
        return False
    stack: list[str] = []
    seen = seen.translate(_STRAIGHT)
    i, n = 0, len(seen)
    verbatim = ""  # the fence, ticks or dollars that only their like closes
    item = rows = False
    start = True  # of a line
    while i < n:
        c = seen[i]
        if c == "`" or c == "$" and seen.startswith("$$", i):
            mark = _TICKS.match(seen, i)[0] if c == "`" else "$$"
            if not verbatim:
                verbatim = mark
            elif verbatim == mark or mark[:3] == verbatim[:3] == "```" and len(mark) >= len(verbatim):
                verbatim = ""
            i += len(mark)
            start = item = False
            continue
        if verbatim:
            i += 1
            continue
        if start:
            start = False
            m = _ITEM.match(seen, i)
            if m:
                item = True
                i = m.end()
                continue
            line = seen[i : (seen.find("\n", i) + n + 1) % (n + 1)] if c in " \t|" else ""
            if line.lstrip().startswith("|"):
                if rows and not _ROW.fullmatch(line) and i + len(line) >= n:
                    return True
                rows = True
        if c == "\n":
            if item and stack[-1:] != ["item"]:
                item = False  # an empty item between others is only empty
            if seen.startswith("\n", i + 1):
                stack = [x for x in stack if x[0] not in "*_~"]
                rows = False
            start = True
            i += 1
            continue
        if item and not c.isspace():
            item = False
        if c == "\\":
            i += 2
            continue
        if c == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            elif not (i and seen[i - 1].isdigit() and (i + 1 == n or not seen[i + 1].isalnum())):  # inches
                stack.append(c)
        elif c in _OPEN:
            if not (i and seen[i - 1] in ":;=" and c in "([{"):  # ":(" is a face
                stack.append(c)
        elif c in _CLOSE and _CLOSE[c] in stack:
            top = len(stack) - 1 - stack[::-1].index(_CLOSE[c])
            if '"' not in stack[top + 1 :]:
                del stack[top:]
        elif c in "*_~":
            m = _STRONG.match(seen, i)
            if m:
                mark, before, after = m[0], seen[i - 1] if i else " ", seen[m.end()] if m.end() < n else " "
                if mark in stack and not before.isspace():
                    del stack[len(stack) - 1 - stack[::-1].index(mark) :]
                elif not after.isspace() and not before.isalnum() and (len(mark) > 1 or after.isalpha()):
                    stack.append(mark)
                i = m.end()
                continue
        elif c == "<":
            m = _TAG.match(seen, i)
            if m and not m[0].endswith("/>"):
                name = m[2].casefold()
                if m[1]:
                    if "<" + name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index("<" + name) :]
                elif name not in _VOID:
                    stack.append("<" + name)
                i = m.end()
                continue
        i += 1
    # a lone star may be a footnote's or a rating's
    return bool([x for x in stack if x != "*"]) or bool(verbatim) or (item and "\n" in seen.strip())


_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*/?>")
_VOID = {"br", "hr", "img", "input", "meta", "link", "image", "empty", "p", "li"}

# (?r): these match from the end of a text backwards
# Words that can't end an answer because another must follow, accents kept.
WANTS_MORE = frozenset(
    "và hoặc với của tại trong trên dưới là vì để những các một được bị nhưng cho từ đến như gồm mà thì nếu khi do bằng về ở vào theo cùng hay cũng đang sẽ đã có bởi tuy rằng lúc mỗi mọi giữa sau trước ngoài qua"
    " the a an of and or with in on at to for from is are was were by but because that which as".split()
)
# of these, words that often end a whole phrase as well
_MAY_END = frozenset("trước sau ngoài trong trên dưới qua về có đến vào lúc khi thì từ theo ở một in on by that as to is are was were".split())
_MARKER = regex.compile(r"(?r)(?:^|\n)\s*(?:[-*•+]|\d{1,3}[.)]|[a-z]\))\s*$")
_TAIL = regex.compile(r"[\s\p{So}\p{Sk}\p{Cf}\p{Emoji_Modifier}‍️]+$")
_DOTS = regex.compile(r"(?r)(?:\.{2,}|…)\s*$")
_END = regex.compile(r"[.!?。！？)\]}\"”»’」』】》%ฯ]\s*$")


def _tail(seen: str) -> str:
    return _TAIL.sub("", seen) if seen and not seen[-1].isalnum() and seen[-1] not in ".!?" else seen


_LAST = regex.compile(r"(?r)[\p{L}\p{M}]+$")
_LAST_CLOSED = regex.compile(r"(?r)([\p{L}\p{M}]+)[\p{P}\s]+$")
_WORD_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


@lru_cache(8)
def last_word(seen: str) -> tuple[str, bool, bool] | None:
    """(final word, whether the end is open, whether dots follow) or null if the end isn't a word."""
    t = _tail(seen)
    dots = _DOTS.search(t)
    body = _DOTS.sub("", t).rstrip() if dots else t
    m = _LAST.search(body)
    if not m:
        closed = _LAST_CLOSED.search(body)
        return (closed[1], False, False) if closed else None
    return m[0], True, bool(dots)


def is_truncated(answer: str, ends_in_piece: bool = False) -> bool:
    seen = look(answer)
    if left_open(seen):
        return True
    if _MARKER.search(seen) and _LETTER_RUN.search(seen):
        return True
    t = _tail(seen)
    if t and t[-1] in ",;:，、；：-–—/&+=([{<":
        return True
    w = last_word(seen)
    if w is None or not w[1]:
        return False
    word, _, dots = w
    low = word.casefold()
    if ends_in_piece:
        return True
    if low in WANTS_MORE and (low not in _MAY_END or dots or len(_WORDS.findall(t)) > 3):
        return not regex.search(rf"\bcó\b.*\b{low}$", t.casefold()) if low in ("có",) else True
    if dots:
        return False
    if "," in t and _LINKED.search(t):
        return True
    return word.islower() and len(t) > len(word) and _no_word(low, t)


# Words that link a phrase to what follows.
_LINKS = frozenset("và hoặc với của tại trong trên vì để những các được nhưng cho từ như do bởi".split())
_LINKED = regex.compile(rf",\s*(?:{'|'.join(sorted(_LINKS))})\s+[\p{{L}}\p{{M}}]+$")
_TONES = str.maketrans("", "", "\u0300\u0301\u0303\u0309\u0323")


# Units that may follow a number.
_UNIT = regex.compile(r"\d\s*(?:đ|k|g|kg|mg|m|km|cm|mm|l|ml|h|w|kw|v|tr|%)$|\d\p{L}+$", regex.I)


def _no_word(low: str, text: str) -> bool:
    """Whether a final word of Vietnamese can't be one: no vowel, or a nucleus that wants a final consonant."""
    flat = no_accents(low)
    if not regex.fullmatch(r"[a-z]{1,7}", flat) or _UNIT.search(text):
        return False
    if not regex.search(r"[aeiouy]", flat) or low == "qu":
        return len(flat) <= 4
    if low == "gi":
        return not text.isascii()
    bare = unicodedata.normalize("NFC", unicodedata.normalize("NFD", low).translate(_TONES))
    return bare.endswith(("ươ", "iê", "uô", "yê", "ă", "â"))


# ---------------------------------------------------------------- pieces of words, from all answers

_PIECE_LETTERS = 5
_SALTS = 16


def _word_uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: how often each short word, alone and with the word before it, stands inside, at a
    closed and at an open end; and how often it begins a longer word."""
    for pdf in batches:
        alone, after, closed, opened = Counter(), Counter(), Counter(), Counter()
        for text in pdf["answer"]:
            if text is None:
                continue
            seen = look(text)
            low = _WORD_LETTERS.findall(seen.casefold())
            if not low:
                continue
            end = last_word(seen)
            own = low if end is None else low[:-1]
            alone.update(own)
            after.update(zip(own, own[1:]))
            if end is not None and len(end[0]) <= _PIECE_LETTERS:
                kind = opened if end[1] and not end[2] else closed
                kind.update([(None, low[-1]), (low[-2] if len(low) > 1 else "", low[-1])])
        inner = {(None, w): n for w, n in alone.items() if len(w) <= _PIECE_LETTERS} | {k: n for k, n in after.items() if len(k[1]) <= _PIECE_LETTERS}
        inner, longer = Counter(inner), Counter()
        for w, n in alone.items():
            for k in range(1, min(_PIECE_LETTERS, len(w) - 1) + 1):
                longer[None, w[:k]] += n
        keys = list({*inner, *closed, *opened, *longer})
        yield pd.DataFrame({"before": [b for b, _ in keys], "word": [w for _, w in keys], "inner": [inner[k] for k in keys], "closed": [closed[k] for k in keys], "opened": [opened[k] for k in keys], "longer": [longer[k] for k in keys]})


def word_pieces(answers: DataFrame) -> DataFrame:
    """(before, word): short words that are pieces of words at an open end, by what stands before them.

    A piece stands mostly at open ends and begins longer, commoner words; or it is a word in its
    own right that begins longer ones, but follows this word mostly at open ends (words with accents
    only: texts typed without them are rare and have unseen pairs of their own). Shares decide, not
    counts. Counted over all distinct answers, so that copies change nothing, per batch first, then by
    word; one row per word and word pair leaves a task. The counts are a written table: they are used
    twice and made once.
    """
    uses = answers.select("answer").distinct().mapInPandas(_word_uses, "before string, word string, inner bigint, closed bigint, opened bigint, longer bigint")
    total = uses.groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in ("inner", "closed", "opened", "longer")))
    total = materialize(total.where("before is null or opened > 0"), "uses")
    alone = total.where("before is null").select("word", F.expr("opened > 2 * (inner + closed) and longer > opened").alias("piece"), F.expr("longer > 0.1 * inner and longer > 0").alias("begins")).where("piece or begins")
    ends = total.where("before is not null")
    return ends.join(alone, "word").where(F.expr("piece or (before <> '' and opened > 2 * (inner + closed))") & (F.col("piece") | F.rlike("word", F.lit("[^\\x00-\\x7f]")))).select("before", "word")


@F.pandas_udf(StructType([StructField("defect", StringType()), StructField("before", StringType()), StructField("word", StringType())]))
def _first_look(question: pd.Series, answer: pd.Series) -> pd.DataFrame:
    """Every defect that shows in the pair itself; for the rest, the open final word and the one before it."""
    defects, befores, open_words = [], [], []
    for q, a in zip(question, answer):
        d = b = w = None
        if is_empty(a):
            d = "empty"
        elif copies_question(q or "", a):
            d = "copies_question"
        elif is_refusal(a):
            d = "refusal"
        elif other_language(q or "", a):
            d = "other_language"
        elif is_truncated(a):
            d = "truncated"
        else:
            seen = look(a)
            end = last_word(seen)
            if end is not None and end[1] and not end[2] and len(end[0]) <= _PIECE_LETTERS and (end[0].islower() or end[0].isupper()):
                low = [x.casefold() for x in _WORD_LETTERS.findall(seen)[-2:]]
                b, w = low[0] if len(low) > 1 else "", low[-1]
        defects.append(d)
        befores.append(b)
        open_words.append(w)
    return pd.DataFrame({"defect": defects, "before": befores, "word": open_words})


def flag_defects(pairs: DataFrame, question: str = "question", answer: str = "answer", defect: str = "defect") -> DataFrame:
    """Add the column ``defect``; all other columns and all rows stay as they are.

    Building the query counts the words of all answers (see :func:`word_pieces`).
    """
    taken = set(pairs.columns)
    fresh = lambda name: name if name not in taken else fresh("_" + name)
    seen, before, word, piece = fresh("_seen"), fresh("_before"), fresh("_word"), fresh("_piece")
    rows = pairs.withColumn(seen, _first_look(F.col(question), F.col(answer))).withColumn(before, F.coalesce(F.col(f"{seen}.before"), F.lit(""))).withColumn(word, F.coalesce(F.col(f"{seen}.word"), F.lit("")))
    # most pairs have no open word, and some words are hot: both are spread by a salt, and AQE splits what is skewed still
    salt = fresh("_salt")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(question, answer, *[c for c, t in pairs.dtypes if t in ("bigint", "int")]), F.when(F.col(word) == "", F.lit(65_536)).otherwise(F.lit(_SALTS))))
    pieces = word_pieces(pairs.select(F.col(answer).alias("answer"))).select(F.col("before").alias(before), F.col("word").alias(word), F.lit(True).alias(piece), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))).alias(salt))
    joined = rows.join(pieces, [before, word, salt], "left")
    keep = [F.col(f"`{c}`") for c in pairs.columns if c != defect]
    return joined.select(*keep, F.coalesce(F.col(f"{seen}.defect"), F.when(F.col(piece), "truncated")).alias(defect))
