"""Held-out accuracy, and edge cases, of the two classifiers."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.llm import labelled, ranking, toxicity
from casefile.llm.queries import op3_quality_ranking, op4_toxicity
from tests.compare import TESTDATA

FOLDER = str(TESTDATA / "sf0.01")


@pytest.mark.parametrize(
    ("query", "label", "cut", "least"),
    [(op3_quality_ranking, "quality", 0.5, 0.97), (op4_toxicity, "toxic", 0.7, 0.93)],
)
def test_held_out_accuracy(spark, query, label, cut, least):
    out = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    assert len(out) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    held = [(out[r.doc_id].predicted, r[label]) for r in labels if out[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) >= least


INSULTS = ["blorgy", "snarfel"]


def made_texts() -> list[tuple[str, int]]:
    draw = np.random.default_rng(2)
    parts = np.array("an the ti on er re st nd is at".split())

    def word() -> str:
        return "".join(draw.choice(parts, draw.integers(1, 4)))

    rows = []
    for i in range(160):
        words = [word() for _ in range(draw.integers(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[draw.integers(len(words))] = INSULTS[i // 4 % 2]
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_gapped_and_inserted_letters():
    model = toxicity.fit(made_texts())
    clean, *bad = model.values(
        ["the station is restand", "the BLORGY is", "a b.l.o.r.g.y on", "an snarxfel at", "the blórgy, is", "the bloorgy is"]
    )
    assert all(b > clean for b in bad)
    scores = model.scores(["the station is restand", "the blorgy is", "a b.l.o.r.g.y on", "", "1234 !!"])
    assert (scores >= 0.7).tolist() == [False, True, True, False, False]


def test_worst_word_does_not_depend_on_chunks():
    model = toxicity.fit(made_texts())
    texts = ["", "the blorgy", "é", "  ", "an on snarfel"]
    assert np.allclose(model.values(texts), [model.values([t])[0] for t in texts])


def test_subsequences_against_enumeration():
    stream = np.frombuffer(bytes([31, 1, 2, 3, 4, 5, 31]), np.uint8)
    word, number, weight = toxicity._profile([bytes([1, 2, 3, 4, 5])])
    found = dict(zip(number.tolist(), weight.tolist(), strict=True))
    expected: dict[int, float] = {}
    for a in range(len(stream)):
        for offsets in toxicity.OFFSETS:
            places = [a, *(a + o for o in offsets)]
            if places[-1] < len(stream):
                code = 0
                for p in places:
                    code = code * 32 + int(stream[p])
                expected[code] = expected.get(code, 0) + 0.5 ** (offsets[-1] - 3)
    assert found == pytest.approx(expected)


def test_ranking_by_pairs():
    draw = np.random.default_rng(1)
    truth = np.array([2.0, -1.0, 0.0])
    x, y = draw.normal(size=(5000, 3)), draw.normal(size=(5000, 3))
    first = draw.random(5000) < 1 / (1 + np.exp(-(x - y) @ truth))
    better, worse = np.where(first[:, None], x, y), np.where(first[:, None], y, x)
    assert np.allclose(ranking.fit_pairs(better, worse, 1e-6), truth, atol=0.15)


@pytest.mark.parametrize("module", [ranking, toxicity])
def test_edge_cases(spark, module):
    schema = "doc_id bigint, text string, toxicity int, quality_score string"
    rows = [(1, None, 1, "x"), (2, "", None, None), (2, "", None, None), (None, "words " * 3000, 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for empty in (labels, labels.where("false")):
        out = module.score(docs, module.train(docs, empty)).collect()
        assert len(out) == 4
        value = "toxicity" if module is toxicity else "quality_score"
        assert all(0 <= r[value] <= 1 for r in out)
    assert module.score(docs.where("false"), module.train(docs, labels)).collect() == []


def test_toxicity_cut_does_not_depend_on_the_cap():
    draw = np.random.default_rng(3)
    labels = np.repeat([0, 1], [9000, 600])
    values = draw.normal(labels * 2.0, 1.0)
    whole, capped, bare = (toxicity.Model(np.zeros(1), 0.0, 1.0, 0.0) for _ in range(3))
    toxicity._calibrate(whole, values, labels, np.ones(len(labels)))
    part = np.concatenate((np.arange(600), np.arange(9000, 9600)))
    toxicity._calibrate(capped, values[part], labels[part], np.where(labels[part] == 1, 1.0, 15.0))
    toxicity._calibrate(bare, values[part], labels[part], np.ones(len(part)))

    def lost(model):
        logit = model.slope * values[labels == 0] + model.shift
        return np.mean(logit >= np.log(0.7 / 0.3))

    assert lost(capped) == pytest.approx(lost(whole), abs=0.02) and lost(bare) > 0.1
    assert capped.slope == pytest.approx(whole.slope, rel=0.1)


def test_sample_weights_add_up_to_all_training_labels(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) AS toxic")
    rows = labelled.sample(docs, labels, "toxic", 20).collect()
    kept = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    for label in (0, 1):
        of_label = [r for r in rows if r.label == label]
        assert len(of_label) == 20
        all_of_it = sum((i % 10 == 0) == (label == 1) for i in kept)
        assert sum(r.weight for r in of_label) == pytest.approx(all_of_it)


def test_ranking_threshold_does_not_depend_on_the_cap():
    draw = np.random.default_rng(4)
    labels = np.repeat([0, 1], [800, 8000])
    made = draw.normal(labels[:, None] * [1.0, 0.5], 1.0)
    whole = ranking.fit(made, labels, np.ones(len(labels)))
    part = np.concatenate((np.arange(800), np.arange(800, 1600)))
    capped = ranking.fit(made[part], labels[part], np.where(labels[part] == 1, 10.0, 1.0))
    below = [np.mean(m.strengths(made) < m.threshold) for m in (whole, capped)]
    assert below[0] == pytest.approx(800 / 8800, abs=0.01)
    assert below[1] == pytest.approx(below[0], abs=0.03)
    assert ranking._quantile(made[:, 0], np.ones(len(made)), 0.3) == pytest.approx(np.quantile(made[:, 0], 0.3))


def test_ranking_fit_takes_repeated_ids_once(spark):
    docs = spark.range(90).selectExpr("id AS doc_id", "repeat(if(id % 3 = 0, 'Some words. ', '# 12 '), int(id) + 5) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS quality")
    repeated = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(200)).drop("id"))
    once, more = ranking.train(docs, labels), ranking.train(repeated, labels)
    assert np.allclose(once.weights, more.weights) and once.threshold == pytest.approx(more.threshold)


def test_ranking_learns_from_every_labelled_document(spark):
    """The threshold is the exact quantile of all training scores, and each training
    document is in a pair, however many there are."""
    texts = "repeat(if(id % 4 = 0, 'Some words. ', '# 12 '), int(id * 7 % 40) + 5)"
    docs = spark.range(10_500).selectExpr("id AS doc_id", f"{texts} AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) AS quality")
    rows = ranking._training_rows(docs, labels)
    kept = [i for i in range(10_500) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r.doc_id for r in rows.collect()) == kept
    model = ranking.train(docs, labels, quantile=0.3)
    every = model.strengths(np.array([r.features for r in rows.collect()]))
    assert model.threshold == pytest.approx(np.quantile(every, 0.3), abs=1e-9)
    size = {1: sum(i % 4 == 0 for i in kept), 0: sum(i % 4 != 0 for i in kept)}
    numbered = rows.withColumn("features", F.array(F.col("doc_id").cast("double")))
    pairs = [tuple(int(v) for v in r.features) for r in ranking._pairs(numbered, size, 2).collect()]
    assert len(pairs) == len(set(pairs)) == 2 * size[0]
    assert sorted({i for pair in pairs for i in pair}) == kept
    assert all(better % 4 == 0 and worse % 4 != 0 for better, worse in pairs)
