"""Edge cases of raking, url equivalence and chat snapshots."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casefile.llm import chatlog, mixing, urls
from tests.compare import TESTDATA


def test_raked_margins_meet_targets(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet"))
    counted = docs.withColumn("tokens", mixing.word_count(F.col("text")))
    cells = (
        counted.withColumn("topic", mixing.length_topic(F.col("tokens")))
        .groupBy(*mixing.DIMENSIONS)
        .agg(F.sum("tokens").alias("tokens"))
        .where("tokens > 0")
    )
    targets = mixing.tempered_targets(cells)
    raked = mixing.rake(cells, targets, rounds=25)
    for name, wanted in targets.items():
        have = {r[0]: r[1] for r in raked.groupBy(name).agg(F.sum("weight")).collect()}
        assert have == pytest.approx({r[0]: r[1] for r in wanted.collect()}, rel=1e-3)
    spent = mixing.probabilities(raked, 0.5).agg(F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens")).first()[0]
    assert spent == pytest.approx(0.5, rel=1e-3)


def test_mixing_edge_cases(spark):
    rows = [(1, None, None, None, 9), (2, "", "s", "en", 9), (3, "a b c", None, None, 9), (3, "a b c", None, None, 9), (None, "x", "s", "en", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, weight int")
    out = mixing.mix(docs, budget=1.0).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.probability, r.sampled) for r in out) == [
        (0, 1, 1.0, True), (1, 0, 0.0, False), (2, 0, 0.0, False), (3, 3, 1.0, True), (3, 3, 1.0, True),
    ]
    assert mixing.mix(docs.where("false")).collect() == []
    assert [r.sampled for r in mixing.mix(docs.where("doc_id = 1")).collect()] == [False]


def link(kind: str, target: str) -> str:
    if kind == "canonical":
        return f'<LINK href="{target}" rel="canonical">'
    return f'<meta http-equiv="refresh" content="0; url={target}">'


def test_aliases_follow_decisions(spark):
    pages = [
        (1, "https://www.A.org/x?q=1#f", link("canonical", "http://shop.example.com/de/1")),
        (2, "http://b.org/y", link("refresh", "/z")),
        (3, "http://b.org/z#top", link("canonical", "//www.a.org/x?q=1")),
        (4, "http://c.org/q", link("canonical", "http://d.net/")),
        (5, "http://e.org/q", link("canonical", "http://c.org/q")),
        (6, "http://c.org/fr/q", link("canonical", "http://c.org/q")),
        (7, "http://x.example.net/en/1", None), (8, "http://x.example.net/de/1", ""), (9, "http://example.net", ""),
        (10, None, link("canonical", "http://d.net/")), (11, "no url", None), (12, "http://b.org/y", "<p>"),
        (13, "http://lone.org/", link("canonical", "http://lone.org/")), (14, "http://f.org/p", None),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    logged = spark.createDataFrame([("http://f.org/p", "http://g.net/")], "source_url string, target_url string")
    out = {r.page_id: r for r in urls.judge(frame, urls.rule_table(spark), logged).collect()}
    assert len(out) == len(pages)
    assert {i: r.verdict for i, r in out.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block",
        9: "allow", 10: "allow", 11: "allow", 12: "block", 13: "allow", 14: "block",
    }
    assert (out[1].host, out[1].path, out[1].rule) == ("www.a.org", "/x", None)
    assert (out[6].rule, out[7].rule, out[8].rule) == ("org/fr/", "example.net/en/", "net/")
    assert (out[10].host, out[10].path, out[11].host) == ("", "", "")
    assert urls.judge(frame.where("false"), urls.rule_table(spark)).collect() == []


@pytest.mark.parametrize("block", [4096, 2])
def test_snapshots_collapse(spark, monkeypatch, block):
    monkeypatch.setattr(chatlog, "BLOCK_TURNS", block)
    monkeypatch.setattr(chatlog, "PART_TURNS", 4)
    talk = [("user", f"t{i}") for i in range(9)]
    logs = {10: talk, 11: talk[:3], 12: talk[:8], 9: [*talk[:3], ("user", "other")], 13: talk[1:], 7: [("user", "")], 14: talk, 15: [("system", "t0")]}
    rows = [(c, k, role, text, 1) for c, turns in logs.items() for k, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "t0", 1), (8, None, None, None, 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int")
    out = chatlog.render(turns).collect()
    parts: dict[int, dict[int, str]] = {}
    for r in out:
        parts.setdefault(r.conv_id, {})[r.part] = r.rendered
        assert r.n_turns <= 4
    whole = {c: "".join(p[k] for k in sorted(p)) for c, p in parts.items()}
    rendered = {c: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in logs[c]) for c in (7, 9, 10, 13, 15)}
    assert whole == rendered | {8: "<|" + "|>\n<|end|>\n"}
    assert chatlog.render(turns.where("false")).collect() == []
