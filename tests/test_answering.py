"""Answers with evidence, their validation, and exported reports."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casefile.operators import answers, retrieval, trace, uploads
from casefile.session import work_dir
from casefile.sources import sinks

UNIT = "kind string, doc_id bigint, source string, unit_no bigint, unit string"


def brute_force(units, questions, k):
    """BM25 over the units by its formula."""
    words = {u[:2] + (u[3],): re.findall(r"\w+", u[4].lower()) for u in units}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for item, text in questions:
        scored = []
        for key, own in words.items():
            tf = Counter(own)
            shared = set(re.findall(r"\w+", (text or "").lower())) & set(own)
            score = sum(
                math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(own) / mean))
                for t in shared
            )
            if shared:
                scored.append((-round(score, 6), key))
        out[item] = [key for _, key in sorted(scored)[:k]]
    return out


@pytest.fixture
def units():
    texts = ["field 37 holds the number", "the number of a field", "reversal of a field", "an answer code", "the the the"]
    rows = [("document", d, f"s{d % 2}", n, t) for d in (2, 11) for n, t in enumerate(texts, 1)]
    return rows + [("page", 2, None, 4, "reversal code"), ("page", 2, None, 30, "reversal code")]


def test_units_are_ranked_and_cited_as_by_the_formula(spark, units):
    questions = [(1, "which field holds the number"), (2, "Reversal code?"), (3, "nothing alike"), (4, None), (5, "")]
    asked = spark.createDataFrame(questions, "item_id bigint, text string")
    rows = retrieval.section_top_k(spark.createDataFrame(units, UNIT), asked).collect()
    found = {item: [] for item, _ in questions}
    for r in sorted(rows, key=lambda r: (r.item_id, r["rank"])):
        found[r.item_id].append((r.kind, r.doc_id, r.unit_no))
    assert found == brute_force(units, questions, 3)
    texts = {(u[0], u[1], u[3]): (u[2], u[4]) for u in units}
    assert all(texts[r.kind, r.doc_id, r.unit_no] == (r.source, r.unit) for r in rows)


def test_documentation_answer_keeps_questions_without_a_passage(spark, units):
    asked = spark.createDataFrame([(1, "How is a reversal made?"), (2, "zzz"), (3, None)], "item_id bigint, text string")
    passages = retrieval.section_top_k(spark.createDataFrame(units, UNIT), asked)
    rows = {r.item_id: r for r in retrieval.documentation_answers(asked, passages).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].intent == "procedure" and len(rows[1].answer.story) == 3 == len(rows[1].citations)
    sources = [r.source for r in rows[1].answer.references]
    assert len(sources) == len(set(sources)) >= 1
    for item in (2, 3):
        assert rows[item].answer.story == [] and rows[item].answer.references == [] and rows[item].citations == []


def test_no_units_no_questions(spark, units):
    asked = spark.createDataFrame([(1, "field")], "item_id bigint, text string")
    none = spark.createDataFrame([], UNIT)
    assert retrieval.section_top_k(none, asked).count() == 0
    assert retrieval.section_top_k(spark.createDataFrame(units, UNIT), asked.limit(0)).count() == 0


def test_issues_name_their_passage(spark):
    cards = spark.createDataFrame(
        [("a", "ERROR", 3, ["R1", "R4"]), ("b", "OK", 1, []), ("c", "OK", 2, ["R2"])],
        "rrn string, status string, n_lines bigint, rules array<string>",
    )
    told = cards.select("rrn", F.lit(1).alias("first_step"), F.array(F.lit("x")).alias("story"))
    evidence = spark.createDataFrame(
        [("R1", 5, "spec"), ("R4", 6, "spec")], "rule string, doc_id bigint, source string"
    )
    rows = {r.conversation_id: r.answer for r in trace.structured_answers(told, cards, evidence).collect()}
    assert [i.detail for i in rows["a"].issues] == ["See document 5, spec.", "See document 6, spec."]
    assert [r.source for r in rows["a"].references] == ["spec"]
    assert rows["b"].references == [] and rows["c"].references == []
    assert rows["c"].issues[0].detail is None
    plain = trace.structured_answers(told, cards).collect()
    assert all(r.answer.references == [] for r in plain)


def test_validation_names_the_fields_at_fault(spark):
    bodies = [
        (1, '{"summary":""}'),
        (2, "{}"),
        (3, '{"summary":'),
        (4, None),
        (5, '{"summary":"s","issues":[{"severity":"critical","title":"t"}]}'),
        (6, '{"summary":"s","issues":[{"severity":"info"}],"references":[{"page":2}]}'),
        (7, '{"summary":"s","issues":[{"severity":"error","title":"t"}],"references":[{"source":"x"}]}'),
        (8, '{"summary":"s","issues":[{"title":"t"}]}'),
    ]
    rows = answers.validation(spark.createDataFrame(bodies, "id int, body string"), "id").collect()
    assert {r.id: (r.status, r.faults) for r in rows} == {
        1: (200, []),
        2: (422, ["summary"]),
        3: (422, ["body"]),
        4: (422, ["body"]),
        5: (422, ["issues"]),
        6: (422, ["issues", "references"]),
        7: (200, []),
        8: (422, ["issues"]),
    }


def test_a_batch_for_an_unknown_agent_is_refused(spark):
    schema = "request_id int, ordinal int, agent string, filename string, content_type string, size bigint"
    rows = [(1, 0, "log", "a.log", "t", 4), (2, 0, "other", "a.log", "t", 4), (3, 0, None, "a.exe", "t", 4)]
    found = uploads.request_status(spark.createDataFrame(rows, schema)).collect()
    assert {r.request_id: (r.status, r.n_files) for r in found} == {1: (200, 1), 2: (422, 0), 3: (422, 0)}


@pytest.fixture
def report(spark):
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(f"r{i}", when if i % 3 else None, i, ["a\nb", 'q"'] if i % 2 else []) for i in range(50)]
    return spark.createDataFrame(rows, "rrn string, at timestamp, n bigint, story array<string>")


@pytest.mark.parametrize("kind", ["json", "txt"])
def test_exported_reports_read_as_written(spark, report, kind):
    target = work_dir(spark, "export-test")
    manifest = sinks.export_report(report, target, "rrn", buckets=4)
    back = sinks.read_report(spark, target, report.schema, kind)
    assert sorted(back.drop("bucket").collect()) == sorted(report.collect())
    counted = {r.bucket: r.n_rows for r in manifest.where(F.col("format") == kind).collect()}
    assert sum(counted.values()) == 50 and len(counted) == 4
    assert back.where("bucket = 1").count() == counted[1]
    stored = spark.read.json(f"{target}/manifest")
    assert stored.count() == manifest.count()


def test_an_empty_report_has_an_empty_manifest(spark, report):
    target = work_dir(spark, "export-test")
    assert sinks.export_report(report.limit(0), target, "rrn").count() == 0


def test_a_report_that_differs_leaves_no_manifest(spark, report, monkeypatch):
    target = work_dir(spark, "export-test")
    whole = sinks.read_report
    monkeypatch.setattr(sinks, "read_report", lambda *a: whole(*a).where("n <> 7"))
    with pytest.raises(RuntimeError):
        sinks.export_report(report, target, "rrn", buckets=4)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.json(f"{target}/manifest")
