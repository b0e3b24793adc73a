"""Texts as NumPy arrays, inside tasks.

A task handles its texts in chunks of bounded length, so memory does not grow
with the Arrow batch. A word is a run of characters other than the space and
U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_CHARS = 400_000
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def in_chunks(ids: list, texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator:
    """(ids, texts) of consecutive rows, each of about ``limit`` characters or one
    longer text; a null text counts as empty."""
    start, size = 0, 0
    texts = [t or "" for t in texts]
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of several texts: ``doc`` is non-decreasing; ``first`` has the
    index of each text's first word and, last, the number of words."""

    n_docs: int
    codes: np.ndarray  # code points of all texts, a line feed after each
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number per character, by text."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.text_start[1:]] - total[self.text_start[:-1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str], fold: bool = False) -> Words:
    """``fold`` lower-cases A to Z."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if fold:
        codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_start = np.concatenate(([0], np.cumsum(lengths)))
    inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.searchsorted(start, text_start)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(len(texts), codes, text_start, start, end, doc, first)


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of the words, equal for equal words in any task.

    A polynomial over mixed code points, from running sums modulo 2**64: the sum
    of a word is brought to the power 0 by the inverse of the step's power.
    """
    n = len(words.codes)
    if not len(words.start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        terms = mix((words.codes.astype(np.uint64) + np.uint64(1)) * _MIX) * power[:n]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        raw = (total[words.end] - total[words.start]) * inverse[words.start]
        return mix(raw + (words.end - words.start).astype(np.uint64) * _MIX)


_CACHE: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    if "p" not in _CACHE or len(_CACHE["p"][0]) < n:
        size = max(n, 2 * CHUNK_CHARS)
        inverse = np.uint64(pow(int(_STEP), -1, 2**64))
        with np.errstate(over="ignore"):
            made = tuple(
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base))), dtype=np.uint64)
                for base in (_STEP, inverse)
            )
        _CACHE["p"] = made
    return _CACHE["p"]


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``width`` words; a text with fewer words has
    its whole sequence as its one run, one without words has none."""
    hashes, counts = word_hashes(words), words.counts()
    n = len(hashes)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            shifted = np.zeros(n, np.uint64)
            shifted[: max(0, n - k)] = hashes[k:]
            shifted[words.first[words.doc + 1] - k <= np.arange(n)] = 0
            total = mix(total * _STEP + shifted + np.uint64(k))
    place = np.arange(n) - words.first[words.doc]
    kept = place <= np.maximum(0, counts[words.doc] - width)
    return total[kept], words.doc[kept]
