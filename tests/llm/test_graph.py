"""Connected components, and the size of their plans."""

from __future__ import annotations

import random

from casefile.llm import graph


def smallest(edges: list[tuple]) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def test_chains_stars_and_random_graphs_with_one_join_a_plan(spark, monkeypatch):
    """A plan that holds both halves of a round had ten joins and more, and what the
    driver compiles for each stays in its memory."""
    joins, write = [], graph.saved

    def saved(df, purpose):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, purpose)

    monkeypatch.setattr(graph, "saved", saved)
    rng = random.Random(6)
    chain = list(range(-40, 0))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), *((1000, k) for k in range(900, 1100)), (7, None), (None, 8), (9, 9)]
    edges += [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]]
    found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(tuple(r) for r in found) == sorted(smallest(edges).items())
    assert max(joins) == 1
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
