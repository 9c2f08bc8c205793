"""Words of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

SLICE_CHARS = 2_000_000  # characters worked on at once; bounds the memory whatever the batch
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Words:
    """hash[k] is word k; the words of text d are begin[d] up to begin[d + 1]."""

    hash: np.ndarray
    begin: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


def slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SLICE_CHARS together; a longer text gets a range of its own."""
    at, total = 0, 0
    for k, n in enumerate(lengths):
        if k > at and total + n > SLICE_CHARS:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, a line feed after each text, and where each text begins."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


@cache
def letters() -> np.ndarray:
    """TRUE at the code points of letters."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def run_hashes(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run codes[begin : begin + size]; runs are in order, don't overlap and aren't empty."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(size)
    offset = np.arange(ends[-1]) - np.repeat(ends - size, size)
    at = np.repeat(begin, size) + offset
    terms = (codes[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[offset]
    return mix(np.add.reduceat(terms, ends - size) + size.astype(np.uint64))


def words_of(texts: list[str], is_word: np.ndarray | None = None) -> Words:
    """Words are runs of word characters (letters, unless a table over code points is given) in lower case."""
    codes, first = code_points([t.lower() for t in texts])
    inside = (letters() if is_word is None else is_word)[codes]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(run_hashes(codes, begin, end - begin), np.searchsorted(begin, first))


def gram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether all of them lie in the word's text."""
    h, total = words.hash, len(words.hash)
    if total < n:
        return np.zeros(total, np.uint64), np.zeros(total, bool)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out[: total - n + 1] = out[: total - n + 1] * _BASE + h[k : total - n + 1 + k]
    text_end = np.repeat(words.begin[1:], np.diff(words.begin))
    return mix(out), np.arange(total) + n <= text_end
