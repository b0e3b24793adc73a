"""The pivot index against all cosines."""

from __future__ import annotations

import numpy as np
import pytest

from casefile.llm import pivots

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows: dict[int, np.ndarray], least: float = 0.95) -> dict[int, tuple[int, int]]:
    ids = list(rows)
    units = np.array([rows[i].astype(float) for i in ids])
    units /= np.linalg.norm(units, axis=1)[:, None]
    linked = units @ units.T >= least
    np.fill_diagonal(linked, False)
    name = np.array(ids)
    while True:
        new = np.array([min([name[k], *name[linked[k]]]) for k in range(len(ids))])
        if (new == name).all():
            break
        name = new
    return {i: (int(linked[k].sum()), int(name[k])) for k, i in enumerate(ids)}


def made() -> dict[int, np.ndarray]:
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=16) for _ in range(300)]
    rows += [rows[7] + rng.normal(scale=0.05, size=16) for _ in range(120)]
    rows += [rows[i] + rng.normal(scale=0.06, size=16) for i in range(20, 60)]
    rows += [rows[9]] * 15 + [rows[11] * 3.0] * 2
    return {5000 - i: np.float32(r) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [2000, 30])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = made()
    frame = spark.createDataFrame([(i, r.tolist(), 0) for i, r in rows.items()], SCHEMA)
    out = {r.vec_id: r for r in pivots.near_vectors(frame.repartition(4), pivots=40).collect()}
    expected = brute(rows)
    assert out.keys() == expected.keys()
    links = sum(r.n_links for r in out.values())
    assert links >= 0.97 * sum(n for n, _ in expected.values())
    for i, (n, smallest) in expected.items():
        assert out[i].n_links <= n
        assert out[i].component_id >= smallest
        assert out[i].kept == (out[i].component_id == i)
    assert out[5000 - 9].n_links == 15
    assert np.mean([out[i].component_id == c for i, (_, c) in expected.items()]) > 0.97


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0),
        (6, [inf, 1.0], 0), (7, [1.0, None], 0), (8, [], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0),
        (1, [1.0, 0.0], 0),
    ]
    out = pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out))
    assert found == [
        (0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True),
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
    ]
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
