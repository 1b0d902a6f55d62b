"""Plain words out of typeset text, a batch of whole texts at a time.

Texts are joined with NUL and cleaned by few regular expressions over the joined string, so the cost per text is small.
No text is shortened; a batch is cut only between texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

#: Characters of text that are worked on at once (a longer text is a piece of its own).
PIECE_CHARS = 2_000_000
#: Invisible characters that typesetting puts inside words.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]{0,9})(?:\s[^<>\0]{0,200})?/?>")
NOTE = re.compile(r"\[[A-Za-z0-9*]{1,6}\]")
PREFIX = re.compile(r"(?m)^[ \t]*[>|#]+[ \t]?")
# each begins with a plain character, which the engine finds fast
WRAPPED = re.compile(r"-(?<=[^\W\d_]-)(?:[ \t]*\n[ \t]*)?(?=[^\W\d_])")
THOUSANDS = re.compile(r",(?<=\d,) ?(?=\d{3}(?!\d))")
BLOCKS = frozenset(("p", "br", "div", "li", "ul", "ol", "tr", "td", "table", "h1", "h2", "h3", "h4"))


def pieces(texts: list[str | None], limit: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def clean(texts: list[str | None]) -> str:
    """The texts, each ended by NUL, without markup, notes, line prefixes, invisible characters and breaks inside words.

    Compounds are written together, with or without a line break at their hyphen; null texts are empty.
    """
    s = "\0".join([(t if t.isascii() else _folded(t)).replace("\0", " ") if t else "" for t in texts]) + "\0"
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = TAG.sub(lambda m: "\n\n" if m[1].lower() in BLOCKS else "", s)
    if "[" in s:
        s = NOTE.sub("", s)
    s = PREFIX.sub("", s)
    s = WRAPPED.sub("", s)
    return THOUSANDS.sub("", s.replace(" ,", ","))


def _folded(text: str) -> str:
    for c in INVISIBLE:
        text = text.replace(c, "")
    return unicodedata.normalize("NFKC", text)


class WordIds(dict):
    """64-bit numbers of words, remembered; 0 for NUL."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        n = 0 if word == "\0" else xxhash.xxh64_intdigest(word) | 1
        self[word] = n
        return n


WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|\0")


def word_ids(texts: list[str | None], ids: WordIds) -> np.ndarray:
    """The words of all texts as numbers, each text ended by 0."""
    words = WORD.findall(clean(texts).lower().replace("’", "'"))
    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words; 0 where the run crosses the end of a text. One for each start position."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(size):
            w = words[k : k + n]
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            whole &= w != 0
    return np.where(whole, h | np.uint64(1), np.uint64(0))
