"""The pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline as pipeline
from casefile.llm import mixing, queries
from tests.compare import TESTDATA
from tests.llm.test_jaccard import brute

FOLDER = str(TESTDATA / "sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r.doc_id for r in queries.op4_toxicity(spark, FOLDER).collect() if r.predicted}
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "similar", "pii", "mixing", "pieces"]
    stages = dict(pipeline.STAGES)

    first = stages["toxicity"](spark, docs, FOLDER).cache()
    rows = {r.doc_id: r for r in first.collect()}
    assert rows.keys() == {r.doc_id for r in docs.collect()} - toxic and toxic

    second = stages["similar"](spark, first, FOLDER).cache()
    groups = brute([(i, r.text) for i, r in rows.items()])
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    third = stages["pii"](spark, second, FOLDER).cache()
    changed = {r.doc_id: r for r in third.collect()}
    assert changed.keys() == {r.doc_id for r in second.collect()}
    assert any("[EMAIL]" in r.text for r in changed.values())
    assert all(r.n_chars == len(r.text) and "@mail" not in r.text for r in changed.values())

    fourth = stages["mixing"](spark, third, FOLDER)
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in mixing.mix(third).where("sampled").collect()}
    for frame in (first, second, third, fourth):
        assert frame.columns == docs.columns
    last = stages["pieces"](spark, fourth, FOLDER)
    assert sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, FOLDER).collect()) == sorted(
        (r.doc_id, r.n_tokens) for r in last.collect()
    )


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "one two three", None, None, None), (1, "one two three", None, None, None), (2, None, "en", "s", 0), (None, "one two three", "en", "s", 1), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for given, expected in ((docs, [(1, "one two three"), (2, None), (3, "")]), (docs.where("false"), [])):
        out = given
        for name, stage in pipeline.STAGES[:3]:
            out = stage(spark, out, FOLDER)
            assert out.columns == docs.columns
            if name == "similar":
                assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(expected, key=str)
        pipeline.STAGES[4][1](spark, pipeline.STAGES[3][1](spark, out, FOLDER), FOLDER).collect()
