"""Suffix-array measures against brute force."""

from __future__ import annotations

import random
import re

import pytest

from casefile.llm import repetition
from casefile.llm.chunks import in_chunks, words_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def longest_from(words: list[str], i: int) -> int:
    best = 0
    for j in range(len(words)):
        if j == i:
            continue
        k = 0
        while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        best = max(best, k)
    return best


def brute(text: str, least: int) -> list[int]:
    words = WORD.findall(text)
    n = len(words)
    lengths = [longest_from(words, i) for i in range(n)]
    windows, covered = set(), set()
    for i, length in enumerate(lengths):
        if length >= 5:
            windows.update(range(i, i + 5))
        if length >= least:
            covered.update(range(i, i + length))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    maximal = sum(
        length >= least and not (i and lengths[i - 1] > length) for i, length in enumerate(lengths)
    )
    return [
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup,
        len(windows), len(covered), max(lengths, default=0), maximal,
    ]


def made_texts() -> list[str]:
    rng = random.Random(3)
    texts = ["", " \n\t ", "a", "a a", "a b c d e f g h i j", "x " * 60, "a b é \U0001f600 #|"]
    for size in (3, 12, 40, 90):
        for letters in ("ab", "abcdef"):
            texts.append(" ".join(rng.choice(letters) for _ in range(size)))
    passage = " ".join(f"w{i}" for i in range(20))
    texts.append(f"{passage}\nnew one\n{passage}\n{passage} end")
    return texts


def test_measures_match_brute_force():
    texts = made_texts()
    found = zip(*repetition.measure(texts, 3), strict=True)
    for text, row in zip(texts, found, strict=True):
        assert list(row) == brute(text, 3), text


def test_chunks_change_nothing():
    texts = made_texts()
    whole = [list(map(int, x)) for x in zip(*repetition.measure(texts, 3), strict=True)]
    parts = []
    for _, part in in_chunks(texts, texts, limit=50):
        parts += [list(map(int, x)) for x in zip(*repetition.measure(part, 3), strict=True)]
    assert parts == whole
    assert words_of(["a b", ""]).first.tolist() == [0, 2, 2]


@pytest.mark.parametrize("copies", [1, 3])
def test_verdicts(spark, copies):
    clean = " ".join(f"c{i}" for i in range(60))
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [
        (1, None, "x", 1), (2, "", None, 1), (3, clean, "x", None),
        (4, f"{clean} {passage} {passage}", "x", 1), (5, "few words", "x", 1),
        (None, clean, "x", 1), (7, f"{passage} {passage} {passage}", "x", 1),
    ] * copies
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words int")
    out = repetition.repetition(docs).collect()
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in out}
    assert len(out) == len(rows)
    assert verdicts == {
        1: (True, False), 2: (True, False), 3: (False, True), 5: (True, False),
        4: (True, False), None: (False, True), 7: (True, False),
    }


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert repetition.repetition(docs).collect() == []
