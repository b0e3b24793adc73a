"""Components of the similarity join against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from casefile.llm import jaccard
from casefile.llm.graph import components
from tests.compare import TESTDATA

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows: list[tuple]) -> dict:
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                if 100 * len(a & b) >= 75 * len(a | b):
                    root[find(i)] = find(j)
    smallest: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        smallest[find(i)] = min(key, smallest.get(find(i), key))
    return {rows[i][0]: (len(sets[i]), smallest[find(i)]) for i in range(len(rows))}


def made_rows() -> list[tuple]:
    rng = random.Random(11)
    texts: list[str | None] = [None, "", " \n", "One", "one", "a b c", "A b  C", "É x", "é x"]
    base = [f"w{i}" for i in range(60)]
    for _ in range(40):  # near copies, some only linked through others
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 12
    passage = " ".join(f"p{i}" for i in range(15))
    for i in range(40):  # a common passage alone links nothing
        texts.append(" ".join(f"u{i}x{j}" for j in range(rng.randint(5, 60))) + " " + passage)
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 40, 4)]
    return [(1000 - i, t) for i, t in enumerate(texts)]


def found(spark, rows) -> dict:
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, id int, want string")
    out = jaccard.similar_components(docs.repartition(4)).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_made_documents(spark):
    rows = made_rows()
    assert found(spark, rows) == brute(rows)


def test_parities_bound_what_is_not_shared():
    """Never more bits differ than shingles are unshared, whatever the sizes; unlike
    sets of like size are told apart."""
    rng = np.random.default_rng(5)
    far = missed = 0
    for turn in range(200):
        pool = rng.integers(-(2**63), 2**63 - 1, 900)
        x = np.unique(rng.choice(pool, rng.integers(1, 800), replace=False))
        y = np.unique(rng.choice(pool, rng.integers(1, 800), replace=False)) if turn % 4 else x
        doc = np.repeat([0, 1], [len(x), len(y)])
        one, other = jaccard._parities(np.concatenate((x, y)), doc, np.array([len(x), len(y)]))
        unshared = len(np.setxor1d(x, y))
        bits = jaccard._apart(one, other)
        assert bits <= unshared and bits == jaccard._apart(other, one)
        like = 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y))
        if like and 7 * unshared > 2 * (len(x) + len(y)):
            far += 1
            missed += 7 * bits <= len(x) + len(y)
    assert far > 10 and missed <= far // 10


def test_fragments_are_ranges_of_the_order():
    hashes = np.sort(np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 4000))
    levels = np.zeros(4000, np.int8)
    levels[::3] = 2 + np.arange(len(levels[::3])) % 5
    common = (hashes[levels > 0], levels[levels > 0])
    before, own = jaccard._ranks(common, 2.0 ** common[1], 40_000)
    level = jaccard._levels(common, hashes)
    rank = before[level] + own[level] * (hashes / 2.0**64 + 0.5)
    assert (np.diff(rank[np.lexsort((hashes, level))]) >= 0).all()
    assert rank.min() >= 0 and rank.max() <= 1 + 1e-9


def test_hub_rounds_and_last_round_agree(spark, monkeypatch):
    rows = made_rows()
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    assert found(spark, rows) == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()}
    assert out == brute(rows)


def test_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    text = "the same few words here again"
    rows = [(None, text), (None, text), (7, text), (7, text), (8, None), (None, None)]
    out = jaccard.similar_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [
        (0, 0, 0), (0, 2, 7), (0, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8),
    ]
    assert jaccard.similar_components(spark.createDataFrame([], schema)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    out = {r.node: r.component for r in components(frame).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(frame.where(F.lit(False))).collect() == []
