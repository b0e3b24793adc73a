"""Repetition rules from suffix arrays.

The words of many texts are sorted as suffixes by prefix doubling; a suffix never
equals one of another text, because the first rank holds the text. Intervals of
the array with a common prefix are the text's repeated substrings; at a place,
the longest one has the larger of the two neighbouring prefix lengths. A repeat
is maximal when the one a word earlier does not contain it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.chunks import Words, in_chunks, mix, word_hashes, words_of

SYMBOLS = np.array(sorted(map(ord, "#*$%&|<>")), dtype=np.uint32)


def suffix_array(keys: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and by level k the ranks of prefixes of 2**k words:
    equal ranks mean equal prefixes. ``keys`` differ between texts.

    A rank is the place where its group of equal prefixes begins, so only groups
    of two and more are sorted again by the rank that follows.
    """
    n = len(keys)
    end = first[doc + 1]
    order = np.argsort(keys, kind="stable")
    begins = np.concatenate(([True], np.diff(keys[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    levels, step = [], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank] > 1)
        if not len(open_):
            break
        levels.append(rank)
        after = open_ + step
        second = np.where(after < end[open_], rank[np.minimum(after, n - 1)], -1)
        pair = rank[open_] * (n + 1) + second + 1
        order = np.argsort(pair, kind="stable")
        pair, old = pair[order], rank[open_[order]]
        at = np.arange(len(pair))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(old) != 0)), at, 0))
        run = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(pair) != 0)), at, 0))
        rank = rank.copy()
        rank[open_[order]] = old + run - group
        step *= 2
    return np.argsort(rank, kind="stable"), levels


def repeat_lengths(words: Words) -> np.ndarray:
    """For every word, the number of words of the longest substring that starts
    there and is found at another place of the same text."""
    n = len(words.start)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    with np.errstate(over="ignore"):
        keys = mix(word_hashes(words) + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    suffixes, levels = suffix_array(keys, words.doc, words.first)
    first, second = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = first + common, second + common
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[same] += 1 << k
    best[first] = common
    best[second] = np.maximum(best[second], common)
    return best


def _covered(lengths: np.ndarray, words: Words, least: int, width: int | None) -> np.ndarray:
    """Words per text in the union of the repeats of ``least`` words and more:
    whole, or only their first ``width`` words from every place."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    spans = lengths[at] if width is None else np.full(len(at), width)
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + spans, minlength=n + 1)
    inside = np.cumsum(change)[:n] > 0
    return np.bincount(words.doc[inside], minlength=words.n_docs)


def _repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_covered bigint, longest_repeat bigint, n_maximal bigint"


def measure(texts: list[str], least: int) -> list[np.ndarray]:
    words = words_of(texts)
    lengths = repeat_lengths(words)
    counts = words.counts()
    symbols = np.isin(words.codes, SYMBOLS)
    chars = np.bincount(words.doc, words.end - words.start, minlength=words.n_docs)
    longest = np.zeros(words.n_docs, np.int64)
    np.maximum.at(longest, words.doc, lengths)
    before = np.concatenate(([0], lengths[:-1]))
    new = (lengths >= least) & (lengths >= before)
    return [
        counts,
        chars.astype(np.int64),
        words.per_doc(symbols),
        np.fromiter(map(_repeated_lines, texts), np.int64, len(texts)),
        _covered(lengths, words, 5, 5),
        _covered(lengths, words, least, None),
        longest,
        np.bincount(words.doc[new], minlength=words.n_docs),
    ]


def repetition(
    docs: DataFrame,
    min_repeat: int = 8,
    max_covered: float = 0.2,
    max_longest: int = 100,
    id_column: str = "doc_id",
) -> DataFrame:
    """(id, measures, base_failed, kept) of every document, in one narrow pass.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` and ``n_repeat_words`` are the base counts; ``base_failed`` if
    there are under 10 words, or over 20 % of them lie in five-word windows that
    are found twice. The method's own are ``n_covered`` (words in the union of the
    repeats of ``min_repeat`` words and more), ``longest_repeat`` and ``n_maximal``
    (starts of maximal repeats). ``kept`` unless base_failed, or the covered share
    is over ``max_covered``, or a repeat is longer than ``max_longest`` words.
    Whole texts; null and empty ones have no words and fail. Every row is judged,
    repeats too; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in in_chunks([None] * batch.num_rows, batch.column(1).to_pylist()):
                columns = [batch.column(0).slice(at, len(texts))]
                at += len(texts)
                columns += [pa.array(x, pa.int64()) for x in measure(texts, min_repeat)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, *(m.split()[0] for m in MEASURES.split(", "))])

    rows = docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, {MEASURES}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
