"""The filter audit against every order walked one by one."""

from __future__ import annotations

import random
from itertools import permutations

import pytest

from casefile.llm import audit

CELL = "part string, mask int, n bigint, good bigint, toxic bigint"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def walked(cells: list[tuple], names: str) -> dict:
    """By (part, order, step): the counts, from each mask's way through each order."""
    out, removed_by = {}, {}
    parts = {c[0] for c in cells}
    for part in parts:
        own = [c[1:] for c in cells if c[0] == part]
        for order in permutations(range(len(names))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [c for c in left if c[0] >> f & 1]
                late = [c for c in own if c[0] >> f & 1 and c not in left]
                left = [c for c in left if not c[0] >> f & 1]
                out[part, "".join(names[i] for i in order), step] = (
                    sum(c[1] for c in left),
                    sum(c[1] for c in gone),
                    sum(c[1] for c in late),
                    sum(c[1] for c in own if c[0] == 1 << f),
                    sum(c[2] for c in gone),
                    sum(c[3] for c in gone),
                )
                removed_by[part, f] = removed_by.get((part, f), 0) + sum(c[1] for c in gone)
    return {k: (*v, removed_by[k[0], names.index(k[1][k[2] - 1])]) for k, v in out.items()}


@pytest.mark.parametrize("names", ["A", "AB", "XYZ", "ABCDE"])
def test_every_order(spark, names):
    rng = random.Random(len(names))
    cells = [
        (part, mask, rng.randint(1, 50), rng.randint(0, 9), rng.randint(0, 9))
        for part in ("", "en", "de")
        for mask in range(1 << len(names))
        if rng.random() < 0.7
    ]
    out = audit.interactions(spark.createDataFrame(cells, CELL), names).collect()
    found = {(r.part, r.filter_order, r.step): (*(r[c] for c in COUNTS), r.shapley) for r in out}
    assert len(out) == len(found)
    assert found == walked(cells, names)


def test_intervals_cover_each_failure_once():
    """Every order meets every filter of a mask once: at its step, early or not."""
    n = 4
    for mask, rows in audit.intervals(n).items():
        for rank, order in enumerate(permutations(range(n))):
            met = [(step, early) for step, early, begin, end in rows if begin <= rank < end]
            steps = [k + 1 for k, f in enumerate(order) if mask >> f & 1]
            assert sorted(met) == [(s, s != steps[0]) for s in steps]


def test_parts_without_failures_and_repeated_cells(spark):
    cells = spark.createDataFrame([("a", 0, 3, 1, 0), ("b", 1, 1, 0, 0), ("b", 1, 1, 0, 1)], CELL)
    out = {(r.part, r.filter_order, r.step): r for r in audit.interactions(cells, "AB").collect()}
    assert len(out) == 8
    assert all(r.kept == 3 and r.shapley == 0 for (part, _, _), r in out.items() if part == "a")
    assert tuple(out["b", "AB", 1])[3:] == (0, 2, 0, 2, 0, 1, 4)
    assert tuple(out["b", "BA", 1])[3:] == (2, 0, 0, 0, 0, 0, 0)
    assert audit.interactions(cells.where("false"), "AB").collect() == []
    with pytest.raises(ValueError):
        audit.interactions(cells, "ABCDEFG")


def test_text_failures(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, long, 0),
        (2, " ".join(["w"] * 200), 2),
        (3, "one two", 1),
        (4, "A b c d e f g h i j k l m n", 5),  # one capital of 27 characters
        (5, long + " #", 8),
        (6, "", 1),
        (7, long.replace("w1 ", "W1 "), 0),
        (8, "a a a b", 1),  # exactly half of the words are distinct
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, expected int")
    out = docs.select("doc_id", "expected", audit.text_mask(docs["text"]).alias("mask")).collect()
    assert [(r.doc_id, r.mask) for r in out] == [(r.doc_id, r.expected) for r in out]


def test_copies_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [
            (5, "x", "en", "n1", 1),
            (5, "x", "en", "n2", 2),  # a repeated row is no copy of itself
            (7, "x", "de", "n3", 3),
            (9, "x", None, "n4", 4),
            (None, "x", "en", "n5", 5),
            (1, None, "en", "n6", 6),
            (2, "", "", "n7", 7),
        ],
        "doc_id bigint, text string, lang string, part string, mask int",
    )
    labels = spark.createDataFrame(
        [(7, 1, 0, "a"), (7, 0, 1, "b"), (5, 0, None, "c"), (None, 1, 1, "d")],
        "doc_id bigint, quality int, toxic int, part string",
    )
    out = sorted(tuple(r) for r in audit.text_cells(docs, labels).collect())
    # part, mask, n, good, toxic; one word each, so A fails.
    assert out == [("", 17, 2, 0, 0), ("de", 17, 1, 1, 1), ("en", 1, 4, 0, 0)]
    assert audit.audit(docs.where("false"), labels).collect() == []
    everything = audit.audit(docs, labels.where("false")).collect()
    assert len(everything) == 3 * 120 * 5
    assert all(r.good_lost == 0 for r in everything)
