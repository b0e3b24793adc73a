"""Importance resampling against plain Python, and the sort against ``sorted``."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.llm import resample
from casefile.llm.queries import op13_resample
from tests.compare import TESTDATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def features(text: str | None) -> tuple[int, list[int]]:
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs: list[tuple], target: list[str | None], percent: int = 5) -> set[tuple]:
    """Rows of (doc_id, n_features, weight, score, rank)."""
    made = [(name, *features(text)) for name, text in docs]
    have, want = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, found in made:
        np.add.at(have, found, 1)
    for text in target:
        np.add.at(want, features(text)[1], 1)
    total, wanted = have.sum(), want.sum()
    gains = [
        math.floor(1000 * math.log((t + 1) * (total + 10_000) / ((s + 1) * (wanted + 10_000))))
        for s, t in zip(have.tolist(), want.tolist(), strict=True)
    ]
    rows = []
    for name, n_words, found in made:
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in found)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((name, n_words, len(found), weight, weight + noise))
    eligible = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    ranks = {r[0]: i for i, r in enumerate(eligible[: percent * len(eligible) // 100], 1)}
    return {(r[0], r[2], r[3], r[4], ranks.get(r[0])) for r in rows}


def test_crc_of_joined_strings():
    crc, rng = resample.Crc(), random.Random(4)
    pairs = [(rng.randbytes(rng.choice((0, 1, 5, 70))), rng.randbytes(rng.choice((0, 1, 63, 64, 65, 5000)))) for _ in range(300)]
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    joined = crc.joined(first, second, np.array([len(b) for _, b in pairs], np.int64))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_buckets_of_odd_texts():
    texts = ["", "one", "One  TWO", "É é ÀB-c_d", "a1 2b 3", "x" * 300 + " y", "\x80\x7f日本 語", "a\nb\tc"]
    counts, grams = resample.Features().of(texts)
    for k, text in enumerate(texts):
        n_words, expected = features(text)
        assert counts[k] == n_words
        assert sorted(b for found, doc in grams for b in found[doc == k].tolist()) == sorted(expected)
    assert resample.Features().of([])[0].tolist() == []


def test_whole_table(spark):
    folder = TESTDATA / "sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(str(folder / "documents.parquet")).collect()]
    target = [r.text for r in spark.read.parquet(str(folder / "benchmark.parquet")).collect()]
    out = op13_resample(spark, str(folder))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(docs)
    assert set(rows) == brute(docs, target)


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i % 7}" for i in range(25))
    rows = [(1, None, 9, "a"), (2, "", 9, "b"), (None, text, 9, "c")] + [(3, text, 9, "d")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int, segment string")
    target = spark.createDataFrame([("w1 w2", 5), (None, 6)], "text string, bucket int")
    out = resample.resample(docs, target).collect()
    assert len(out) == 63
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]  # floor(5 * 61 / 100)
    assert {(r.n_features, r.weight) for r in out if r.doc_id in (1, 2)} == {(0, 0)}
    assert resample.resample(docs.where("false"), target).collect() == []
    assert len(resample.resample(docs, target.where("false")).collect()) == 63


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_ranks_of_ties_and_skew(spark, percent):
    """A third of the rows have one score; runs differ in length."""
    rng = random.Random(percent)
    rows = [(k, 7 if k % 3 == 0 else rng.randint(-30, 30), k % 4) for k in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id bigint, score bigint, n_features bigint")
    scored = scored.repartition(7, F.when(F.col("doc_id") < 2000, 0).otherwise(F.col("doc_id") % 11))
    out = resample.ranked(scored, F.col("n_features") > 0, percent)
    eligible = sorted((r for r in rows if r[2] > 0), key=lambda r: (-r[1], r[0]))
    drawn = {r[0]: i for i, r in enumerate(eligible[: percent * len(eligible) // 100], 1)}
    assert {tuple(r) for r in out.collect()} == {(*r, drawn.get(r[0])) for r in rows}
