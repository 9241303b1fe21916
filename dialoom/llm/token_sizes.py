"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

Splitting at single spaces never splits a token, so sizes are sums over space-separated
chunks, and chunks repeat: each is tokenised once per worker and its size kept. Texts that
have runs of white space with a space in them are tokenised whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable


#: Where the vocabulary files are, unless a path is given.
DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Runs of white space with a space in them, where a token may span a chunk's end.
_RUNS = ("  ", "\n ", " \n", "\r ", " \r", "\t ", " \t")
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Chunks whose size a worker keeps.
_KEEP = 1_000_000


class Sizer:
    """Counts tokens; made once per worker process and vocabulary."""

    _made: dict[str, Sizer] = {}

    def __init__(self, path: str = DEFAULT):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._sizes = _Sizes(self.encoding)

    @classmethod
    def get(cls, path: str = DEFAULT) -> Sizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def exact(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def size(self, text: str) -> int:
        """The number of tokens of ``text``."""
        if not text:
            return 0
        tail = 0
        if text[-1].isspace() and not _RARE_SPACE.search(text):
            body = text.rstrip()  # white space at the end makes tokens of its own
            tail = self._sizes.tail(text[len(body) :])
            text = body
            if not text:
                return tail
        if any(map(text.__contains__, _RUNS)) or _RARE_SPACE.search(text):
            return tail + self.exact(text)
        first, *rest = text.split(" ")
        if len(self._sizes) > _KEEP:
            self._sizes.clear()
        return tail + self._sizes.first(first) + sum(map(self._sizes.__getitem__, rest))

    def sizes(self, texts: Iterable[str | None]) -> list[int]:
        return [0 if t is None else self.size(t) for t in texts]

    def pieces(self, parts: list[str]) -> list[int]:
        """Sizes of parts that each start where a token can start."""
        return [self.exact(p) for p in parts]


class _Sizes(dict):
    """Size of a chunk with the space before it."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary
        self.heads: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(" " + chunk))
        if len(chunk) < 100:
            self[chunk] = n
        return n

    def first(self, chunk: str) -> int:
        """Size of a chunk at the start of a text."""
        n = self.heads.get(chunk)
        if n is None:
            n = len(self.encode(chunk)) if chunk else 0
            if len(chunk) < 100 and len(self.heads) < _KEEP:
                self.heads[chunk] = n
        return n

    tail = first
