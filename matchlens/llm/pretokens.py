"""Pre-tokens of the byte-level BPE vocabulary, and a bounded memo of the ids the library gives each.

A byte-level BPE never merges across pre-tokens, so the ids of a text are the ids of its pre-tokens
in a row. The split is done on arrays of code points; a text with a code point whose class this
Python does not know goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
# Code points with the Unicode property White_Space, as inclusive ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Letters that are split off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
PLAIN = re.compile(r" ?\S+").fullmatch
#: Characters split before their new pre-tokens are learned.
AT_ONCE = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode general category."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))
        if kind[0] in "LN":
            table[point] = LETTER if kind[0] == "L" else NUMBER
        elif kind == "Cn":
            table[point] = UNKNOWN
    for low, high in WHITE_SPACE:
        table[low : high + 1] = SPACE
    return table


def split(text: str) -> list[str] | None:
    """The pre-tokens of ``text`` in order, or None where it holds a code point of unknown class."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    if kind.max() == UNKNOWN:
        return None
    n = len(points)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    space = kind == SPACE
    # A run of white space before something else gives its last character away: a plain blank
    # belongs to what follows, any other stands alone.
    after = np.flatnonzero(space[:-1] & ~space[1:])
    start[after] = True
    start[after[points[after] == 0x20] + 1] = False
    if "'" in text:
        _split_contractions(text, points, kind, start)
    ends = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def _split_contractions(text: str, points: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    n = len(points)
    marks = np.flatnonzero(points[:-1] == 0x27)
    marks = marks[kind[marks + 1] == LETTER]
    for i in marks.tolist():
        if not start[i]:
            continue
        letters = next((c for c in CONTRACTIONS if text.startswith(c, i + 1)), None)
        if letters:
            end = i + 1 + len(letters)
            start[i + 1 : end] = False
            if end < n:
                start[end] = True


class PieceMemo:
    """Ids of pre-tokens by the ``tokenizers`` library, remembered up to ``limit`` pre-tokens.

    ``width`` is the bytes per id in what :meth:`ids` returns (little-endian). The memo is a cache
    only: when full it starts again, so its size bounds memory and never the result.
    """

    def __init__(self, path: str, width: int = 2, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.limit = limit
        self.memo: dict[str, bytes] = {}
        (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them, without added special tokens."""
        return [np.asarray(e.ids, self.dtype) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed. Texts are split some at a time, and what they bring is learned at once."""
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < AT_ONCE:
                size += len(texts[end])
                end += 1
            out += self._ids(texts[begin:end])
            begin = end
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        split_texts = [None if self.special(text) else split(text) for text in texts]
        every: set[str] = set()
        for pieces in split_texts:
            every.update(pieces or ())
        known = self.memo
        missing = every.difference(known)
        if len(known) + len(missing) > self.limit:
            known.clear()
            missing = every
        self.learn(missing)
        return [self.encode([text])[0].tobytes() if pieces is None else b"".join([known[p] for p in pieces]) for text, pieces in zip(texts, split_texts)]

    def learn(self, pieces: set[str], at_once: int = 256) -> None:
        """Put pre-tokens into the memo.

        Pre-tokens without white space, but for one leading blank, keep their bounds when a line feed
        stands between them, so many go to the library in one call; the id of the feed tells them apart.
        """
        plain = [p for p in pieces if PLAIN(p)]
        odd = list(pieces.difference(plain))
        groups = [plain[i : i + at_once] for i in range(0, len(plain), at_once)]
        for group, found in zip(groups, self.library.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(found.ids, self.dtype)
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) != len(group) - 1:
                odd.extend(group)
                continue
            packed, width = ids.tobytes(), self.dtype.itemsize
            begin = 0
            for piece, end in zip(group, [*feeds.tolist(), len(ids)]):
                self.memo[piece] = packed[begin * width : end * width]
                begin = end + 1
        for piece, ids in zip(odd, self.encode(odd) if odd else ()):
            self.memo[piece] = ids.tobytes()

    def counts(self, pieces: list[str]) -> list[int]:
        """Number of ids of each pre-token; asked of the library, not remembered."""
        self.memo.clear()
        self.learn({p for p in pieces if not self.special(p)})
        width = self.dtype.itemsize
        return [len(self.memo[p]) // width if p in self.memo else len(self.encode([p])[0]) for p in pieces]

    @functools.cached_property
    def specials(self) -> tuple[str, ...]:
        return tuple(t.content for t in self.library.get_added_tokens_decoder().values())

    def special(self, text: str) -> bool:
        """Whether the text holds an added token's string, which the library finds before it splits."""
        return any(s in text for s in self.specials)


@functools.cache
def piece_memo(path: str, width: int = 2, limit: int = 500_000) -> PieceMemo:
    """One memo per Python worker; it serves all tasks the worker runs."""
    return PieceMemo(path, width, limit)
