"""The characters behind a look: which code points look alike, and which look like nothing.

``look`` maps a text to one representative of all texts that look the same:

* every space (category Zs) is a plain space; line breaks and tabs stay;
* default-ignorable code points and control characters are dropped, except one zero-width
  joiner between two pictographs, which changes the picture;
* width, font and no-break variants become the plain character, ligatures their letters;
* Cyrillic, Greek and Armenian letters with a Latin twin become the twin;
* the result is in composed form (NFC).

Superscripts, circled characters, case, punctuation and the number of spaces are visible
and stay. Null stays null.
"""

from __future__ import annotations

import unicodedata

import regex

# Letters that look like a Latin one. Left: as written; right: the twin.
TWINS = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ν": "v", "ο": "o", "ρ": "p",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    # Latin
    "Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g",
    # Hyphens
    "‐": "-", "‑": "-",
}

#: Vietnamese letters in composed form, by rule: base letter, shape, tone.
VIETNAMESE = "đĐ" + "".join(
    sorted({unicodedata.normalize("NFC", b + t) for b in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY" for t in ("", "̀", "́", "̃", "̉", "̣")} - set("aeiouyAEIOUY"))
)


def _ranges(chars: str) -> str:
    """A character class of as few ranges as possible (regex engines test them one by one)."""
    out, points = [], sorted(map(ord, set(chars)))
    while points:
        n = 1
        while n < len(points) and points[n] == points[0] + n:
            n += 1
        out.append(chr(points[0]) if n == 1 else f"{chr(points[0])}-{chr(points[n - 1])}")
        points = points[n:]
    return "".join(out)


#: Characters that are their own representative whatever stands beside them.
PLAIN = "\\t\\n\\r -~" + _ranges(VIETNAMESE)
#: Java and Python pattern: a text with a match may be written in an uncommon way.
UNCOMMON = f"[^{PLAIN}]"

#: The same for Java, whose classes test ranges one by one but single characters below 256 at once.
UNCOMMON_FAST = "[^{}Ā-ưẠ-ỹ]|[Ā-ư&&[^{}]]".format("".join(f"\\x{o:02x}" for o in range(256) if regex.match(f"[{PLAIN}]", chr(o))), "".join(c for c in VIETNAMESE if "Ā" <= c <= "ư"))

_PLAIN_TEXT = regex.compile(f"[{PLAIN}]*+")
_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_JOINED = regex.compile(r"(?<=\p{Extended_Pictographic}[\p{Emoji_Modifier}\p{Default_Ignorable_Code_Point}]*)‍(?=\p{Default_Ignorable_Code_Point}*\p{Extended_Pictographic})")
_JOINER = ""
_FLATTENED = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")


def atoms(c: str) -> str:
    """What one character contributes: nothing, or base letters and marks in decomposed form."""
    if c == _JOINER:
        return "‍"
    if _IGNORABLE.match(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in _FLATTENED or (tag == "<compat>" and unicodedata.category(c)[0] == "L") or (tag == "<compat>" and unicodedata.category(c) == "Nl"):
        c = unicodedata.normalize("NFKC", c)
    return "".join(TWINS.get(a, a) for a in unicodedata.normalize("NFD", "".join(TWINS.get(x, x) for x in c)))


class _Table(dict):
    def __missing__(self, o: int) -> str:
        self[o] = out = atoms(chr(o))
        return out


TABLE = _Table()


def is_plain(text: str) -> bool:
    return text.isascii() and text.isprintable() or _PLAIN_TEXT.fullmatch(text) is not None


def keep_joiners(text: str) -> str:
    """Zero-width joiners between pictographs, which change the picture, under a code of their own, once each."""
    if "‍" not in text:
        return text
    return regex.sub(f"{_JOINER}(?:\\p{{Default_Ignorable_Code_Point}}*{_JOINER})+", _JOINER, _JOINED.sub(_JOINER, text))


def look(text: str | None) -> str | None:
    if text is None or is_plain(text):
        return text
    return unicodedata.normalize("NFC", keep_joiners(text).translate(TABLE))


def no_accents(text: str) -> str:
    """Letters without their marks; đ is d."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text))).replace("đ", "d").replace("Đ", "D")


_MARKS = regex.compile(r"\p{Mn}+")

#: Everything that carries no content: space, punctuation, and the ASCII symbols used as such.
_FORMATTING = regex.compile(r"[\s\p{P}\p{Z}\p{Cc}$+<=>^`|~]+")


def bare(text: str) -> str:
    """The look without white space, punctuation and letter case."""
    return _FORMATTING.sub("", look(text).casefold())


_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def letters_and_digits(text: str) -> int:
    return sum(map(len, regex.findall(r"[\p{L}\p{N}]+", look(text))))
