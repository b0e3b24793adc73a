"""Operator contracts and invariants on small fixtures."""

from __future__ import annotations

import datetime as dt
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casefile.operators import answers, chat, documents, retrieval, trace, uploads
from casefile.schemas import CONVERSATION, MESSAGE
from casefile.sources import sinks, tables
from tests.compare import TESTDATA, canonical, sql_rows

DAY = dt.datetime(2024, 1, 1)
ID_A, ID_B, ID_C = "a" * 24, "b" * 24, "c" * 24


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


@pytest.fixture
def heads(spark):
    rows = [
        (ID_A, "A", None, at(0), at(0)),
        (ID_B, "B", "log", at(1), at(9)),
    ]
    return spark.createDataFrame(rows, CONVERSATION)


def message(number, conversation, role="user", content="x", seconds=0):
    key = f"{number:024x}"
    return (key, conversation, role, content, None, None, at(seconds))


@pytest.fixture
def stored(spark):
    rows = [
        message(1, ID_A, seconds=1),
        message(2, ID_A, "assistant", None, 2),
        message(3, ID_A, seconds=3),
        message(4, ID_B, seconds=4),
        message(5, ID_C, seconds=5),
    ]
    return spark.createDataFrame(rows, MESSAGE)


def test_history_order_default_and_cap(heads):
    rows = chat.history(heads).collect()
    assert [(r.id, r.agent) for r in rows] == [(ID_B, "log"), (ID_A, "documentation")]
    assert chat.history(heads, 1).count() == 1


def test_find_is_case_insensitive(heads):
    assert chat.find_conversation(heads, ID_A.upper()).count() == 1


def test_one_conversation_left_out(heads):
    assert [r.id for r in chat.without_conversation(heads, ID_A).collect()] == [ID_B]


def test_stamp_is_one_instant(spark):
    rows = chat.stamped(spark.range(1000).repartition(4))
    assert rows.select("created_at").distinct().count() == 1


def test_conversation_messages(stored):
    rows = chat.conversation_messages(stored, ID_A, 2).collect()
    assert [r.content for r in rows] == ["x", ""]
    assert rows[0].attachments == []


def test_timelines_cap(stored):
    rows = chat.timelines(stored, 2).where(F.col("conversation_id") == ID_A)
    assert sorted(r.position for r in rows.collect()) == [1, 2]


def test_groups_and_local_append(stored):
    notice = F.struct(
        F.lit(9).cast("bigint").alias("position"),
        F.lit("n").alias("id"),
        F.lit("assistant").alias("role"),
        F.lit("oops").alias("content"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    groups = chat.append_local(chat.message_groups(chat.timelines(stored)), notice)
    found = {r.conversation_id: [m.content for m in r.messages] for r in groups.collect()}
    assert found[ID_A] == ["x", "", "x", "oops"]


def test_append_precedence(spark, heads):
    rows = [
        message(1, "bad", "system"),
        message(2, "bad"),
        message(3, ID_C),
        message(4, ID_A.upper(), seconds=7),
        message(5, ID_A, None),
    ]
    incoming = spark.createDataFrame(rows, MESSAGE)
    found = chat.append_status(incoming, heads).orderBy("id").collect()
    assert [r.status for r in found] == [422, 400, 404, 201, 422]
    assert found[1].detail == "Invalid conversation ID"
    assert found[2].detail == "Conversation not found"
    accepted = chat.accepted_messages(incoming, heads).collect()
    assert [r.conversation_id for r in accepted] == [ID_A]


def test_touch_never_goes_back(heads, stored):
    touched = chat.touch(heads, chat.last_activity(stored))
    found = {r.id: r.updated_at for r in touched.collect()}
    assert found == {ID_A: at(3), ID_B: at(9)}


def test_creation_bounds(spark):
    titles = ["", " ", "x" * 100, "x" * 101, None]
    rows = [(i, title, None, at(0)) for i, title in enumerate(titles)]
    schema = "conv_id long, title string, agent string, created_at timestamp"
    requests = spark.createDataFrame(rows, schema)
    found = chat.creation_status(requests).orderBy("conv_id").collect()
    assert [r.status for r in found] == [422, 201, 201, 422, 422]
    created = chat.created_conversations(requests).collect()
    assert {r.agent for r in created} == {"documentation"}
    assert all(r.created_at == r.updated_at for r in created)


def test_delete_leaves_no_orphans(spark, heads, stored):
    wanted = [(ID_A.upper(),), (ID_C,), ("bad",)]
    requested = spark.createDataFrame(wanted, "requested_id string")
    kept_heads, kept = chat.delete_cascade(requested, heads, stored)
    assert [r.id for r in kept_heads.collect()] == [ID_B]
    # The unknown id deletes nothing, so its message was and stays an orphan.
    assert {r.conversation_id for r in kept.collect()} == {ID_B, ID_C}
    assert [r.conversation_id for r in chat.orphans(kept, kept_heads).collect()] == [ID_C]
    status = chat.deletion_status(requested, heads, stored).collect()
    found = {r.requested_id: (r.status, r.deleted_messages) for r in status}
    assert found == {ID_A.upper(): (204, 3), ID_C: (404, 0), "bad": (400, 0)}


def test_unknown_agent_has_default_icon(spark):
    rows = spark.createDataFrame([("1", None), ("2", "other"), ("3", "log")], "id string, agent string")
    found = {r.id: (r.agent_name, r.icon) for r in chat.with_agent(rows).collect()}
    assert found["1"] == ("Documentation Agent", "FileText")
    assert found["2"] == ("", "FileText")
    assert found["3"] == ("Log Analysis Agent", "Activity")


UPLOAD = (
    "request_id long, ordinal long, agent string, filename string, "
    "content_type string, size long"
)


@pytest.fixture
def batches(spark):
    mib = 1024 * 1024
    rows = [
        (1, 0, "log", "a.log", "t", 20 * mib),
        (1, 1, "log", "b.pdf", "t", 20 * mib + 1),
        (1, 2, "log", "c.txt", "t", 5),
        (2, 0, "log", "ok.txt", "t", 1),
        (2, 1, "log", "first", "t", 1),
        (2, 2, "log", "second.exe", "t", 1),
    ]
    return spark.createDataFrame(rows, UPLOAD)


def test_batch_fails_with_first_error(batches):
    found = {r.request_id: r for r in uploads.batch_status(batches).collect()}
    assert (found[1].status, found[1].n_files) == (200, 3)
    assert (found[2].status, found[2].n_files) == (400, 0)
    assert found[2].detail == "File extension missing for first."


@pytest.mark.parametrize("page_rows", [1, 2, 1000])
def test_manifest_is_whole_at_any_page_length(batches, page_rows):
    accepted = uploads.accepted_files(batches, page_rows)
    rows = uploads.manifest(accepted).orderBy("request_id", "page").collect()
    assert {r.request_id for r in rows} == {1}
    names = [f.filename for r in rows for f in r.files]
    assert names == ["a.log", "b.pdf", "c.txt"]
    assert all(len(r.files) <= page_rows for r in rows)


def test_removed_position(batches):
    accepted = uploads.accepted_files(batches)
    rows = uploads.attachment_lists(accepted, F.lit(1)).collect()
    assert [a.name for a in rows[0].attachments] == ["a.log", "c.txt"]


def test_a_batch_without_its_only_file_keeps_an_empty_list(spark):
    rows = [(7, 0, "log", "a.log", "t", 1)]
    schema = "request_id int, ordinal int, agent string, filename string, content_type string, size long"
    files = uploads.accepted_files(spark.createDataFrame(rows, schema))
    assert [(r.request_id, r.attachments) for r in uploads.attachment_lists(files, F.lit(0)).collect()] == [(7, [])]


def test_a_file_without_a_place_fails_with_its_batch(spark):
    rows = [(1, None, "log", "a.log", "t", 1), (1, 0, "log", "b.exe", "t", 1), (2, None, "log", "c.log", "t", 1)]
    schema = "request_id int, ordinal int, agent string, filename string, content_type string, size long"
    files = uploads.accepted_files(spark.createDataFrame(rows, schema))
    assert [r.filename for r in files.collect()] == ["c.log"]


def test_pairing_ignores_early_and_undated_replies(spark):
    at = "2024-01-01 00:00:0{}.000000 "
    lines = [
        at.format(1) + "MTI=0110 FLD(037)=1 FLD(039)=05", at.format(2) + "MTI=0100 FLD(002)=4000000000000001 FLD(037)=1",
        at.format(3) + "MTI=0110 FLD(037)=1 FLD(039)=00", "2024-99-01 00:00:05.000000 MTI=0110 FLD(037)=1 FLD(039)=96",
        at.format(4) + "MTI=0110 FLD(037)=1 FLD(039)=05", at.format(5) + "MTI=0110 FLD(037)=2 FLD(039)=00",
        at.format(2) + "HSM< rsp=CB xid=1 rc=15 FLD(037)=1", at.format(3) + "HSM> cmd=CA xid=1 FLD(037)=1",
        at.format(4) + "HSM< rsp=CB xid=1 rc=00 FLD(037)=1", at.format(3) + "HSM> cmd=CA xid=2 FLD(037)=1",
        "2024-99-01 00:00:05.000000 HSM< rsp=CB xid=2 rc=00 FLD(037)=1", at.format(3) + "HSM> cmd=CA xid=3 FLD(037)=1",
    ]
    parsed = trace.parse_trace(spark.createDataFrame([(x,) for x in lines], "line string"))
    cards = {r.rrn: r for r in trace.transactions(parsed).collect()}
    assert (cards["1"].response_code, cards["1"].latency_ms, cards["1"].n_lines) == ("00", 1000, 11)
    assert cards["2"].response_code == "00" and cards["2"].request_ts is None
    exchanges = trace.hsm_exchanges(parsed)
    found = {r.xid: (r.replied, r.reply_ts is not None, r.hsm_return) for r in exchanges.collect()}
    assert found == {"1": (True, True, "00"), "2": (True, False, "00"), "3": (False, False, None)}
    broken = trace.inconsistencies(trace.transactions(parsed), exchanges).collect()
    assert [(r.xid, r.rule) for r in broken] == [("3", "R3")]


def test_latest_value_breaks_ties(spark):
    rows = spark.createDataFrame([("k", "a", 1, 1), ("k", "b", 1, 2), ("k", "c", 0, 9)], "key string, value string, at int, id int")
    assert chat.latest_value(rows, "key", "value", "at", "id").first()["value"] == "b"


def test_size_split_is_a_partition(batches):
    fits, rejected = uploads.split_by_size(batches)
    assert fits.count() + rejected.count() == batches.count()
    found = uploads.size_messages(batches).collect()
    assert [r.message for r in found] == ["The following files exceed 20 MB: b.pdf"]


def test_array_position_removed(spark):
    row = spark.range(1).select(
        uploads.without_position(F.array(F.lit("a"), F.lit("b")), 0).alias("x")
    )
    assert row.collect()[0].x == ["b"]


def test_answers(spark):
    bodies = [
        (1, '{"summary":"s","story":["p","q"],"extra":1}'),
        (2, '{"summary":'),
        (3, '{"summary":"","issues":[{"severity":"odd","title":"t"}],'
            '"references":[{"source":"d","page":null},{"source":"e","page":4}]}'),
    ]
    rows = spark.createDataFrame(bodies, "id long, body string")
    parsed = answers.parse_answers(rows)
    good, bad = answers.split_malformed(parsed)
    assert [(r.id, r.malformed) for r in bad.collect()] == [(2, '{"summary":')]
    shown = answers.sections(good, "id").collect()
    found = sorted((r.id, r.section, r.step, r.line) for r in shown)
    assert found == [
        (1, "story", 1, "p"),
        (1, "story", 2, "q"),
        (1, "summary", 1, "s"),
        (3, "issues", 1, "t"),
        (3, "references", 1, "d"),
        (3, "references", 2, "e p.4"),
    ]
    assert answers.issues(good, "id").collect()[0].severity == "info"
    lists = good.where("id = 1").collect()[0]
    assert lists.issues == lists.recommendations == lists.references == []
    paths = {r.id: r.summary for r in answers.variant_paths(rows, "id").collect()}
    assert paths == {1: "s", 2: None, 3: ""}


LINES = [
    "2024-01-01 00:00:00.000000 MTI=0100 FLD(002)=4000123456789012 FLD(003)=000000 FLD(037)=1",
    "2024-01-01 00:00:00.000000 HSM> cmd=CA xid=1 FLD(037)=1",
    "2024-01-01 00:00:00.100000 HSM< rsp=CB xid=1 rc=15 FLD(037)=1",
    "2024-01-01 00:00:03.001000 MTI=0110 FLD(037)=1 FLD(039)=00",
    "2024-01-01 00:00:05.000000 MTI=0400 FLD(037)=1",
    "2024-01-01 00:00:00.000000 MTI=0110 FLD(037)=2 FLD(039)=05",
    "2024-01-01 00:00:01.000000 MTI=0100 FLD(002)=123 FLD(037)=2",
    "2024-01-01 00:00:01.000000 HSM> cmd=CA xid=7 FLD(037)=2",
    "2024-13-01 00:00:00.000000 MTI=0100 FLD(037)=3",
    "noise FLD(037)= MTI=01",
    "",
]


@pytest.fixture
def parsed(spark):
    return trace.parse_trace(spark.createDataFrame([(x,) for x in LINES], "line string"))


def test_parse_keeps_every_line(parsed):
    rows = parsed.collect()
    assert len(rows) == len(LINES)
    assert rows[0].card == "400012******9012"
    assert rows[6].card == "***"
    assert rows[8].ts is None and rows[8].kind == "0100" and rows[8].rrn == "3"
    assert all(rows[i].kind is None and rows[i].rrn is None for i in (9, 10))


def test_transactions(parsed):
    cards = {r.rrn: r for r in trace.transactions(parsed).collect()}
    assert set(cards) == {"1", "2", "3"}
    assert (cards["1"].status, cards["1"].latency_ms) == ("ERROR", 3001)
    # The response came before the request, so it is not its response.
    assert (cards["2"].status, cards["2"].response_code) == ("UNKNOWN", None)


def test_rules(parsed):
    cards, exchanges = trace.transactions(parsed), trace.hsm_exchanges(parsed)
    rows = trace.inconsistencies(cards, exchanges).collect()
    found = sorted((r.rrn, r.rule, r.severity) for r in rows)
    assert found == [
        ("1", "R1", "error"),
        ("1", "R2", "warning"),
        ("1", "R4", "error"),
        ("2", "R3", "warning"),
    ]
    carded = {r.rrn: r.rules for r in trace.with_rules(cards, exchanges).collect()}
    assert carded == {"1": ["R1", "R2", "R4"], "2": ["R3"], "3": []}


@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_story_and_answers_with_long_transactions(parsed, hot_rows):
    steps = trace.story(parsed, hot_rows)
    functions = [r.function for r in steps.where("rrn = 1").orderBy("step").collect()]
    assert functions == ["authorize", "hsm_command", "hsm_reply", "respond", "reverse"]
    cards = trace.with_rules(trace.transactions(parsed), trace.hsm_exchanges(parsed))
    told = trace.story_pages(steps, 2)
    rows = trace.structured_answers(told, cards).where("conversation_id = 1")
    found = rows.orderBy("first_step").collect()
    assert all(len(r.answer.story) <= 2 for r in found)
    assert sum(len(r.answer.story) for r in found) == 5
    assert [i.severity for i in found[0].answer.issues] == ["error", "warning", "error"]


def test_report_sinks(spark, parsed, tmp_path):
    cards = trace.with_rules(trace.transactions(parsed), trace.hsm_exchanges(parsed))
    report = trace.report(trace.story_pages(trace.story(parsed)), cards)
    sinks.write_json_report(report, str(tmp_path / "json"))
    sinks.write_text_report(report, str(tmp_path / "text"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    texts = spark.read.text(str(tmp_path / "text")).collect()
    assert all('"rrn"' in r.value for r in texts)


def test_table_sinks(spark, heads, tmp_path):
    target = str(tmp_path / "heads")
    sinks.write_version(heads, target)
    sinks.append_rows(heads, target)
    assert spark.read.parquet(target).count() == 4
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_version(heads, target)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES[:2]))
    lines = tables.read_trace_lines(spark, str(tmp_path))
    assert trace.parse_trace(lines).where("rrn = 1").count() == 2
    found = tables.read_text_documents(spark, str(tmp_path)).collect()
    assert [(r.source, r.text) for r in found] == [("a.log", "\n".join(LINES[:2]))]
    listed = tables.read_file_list(spark, str(tmp_path)).collect()
    assert [(r.filename, r.size) for r in listed] == [("a.log", len("\n".join(LINES[:2])))]


def test_trace_equals_expected_counts(spark):
    """FIXTURES section 3.5, at sf0.01."""
    from casefile.sources.views import trace_lines

    events = tables.read_table(spark, "/root/testdata/sf0.01", "events")
    rows = trace.parse_trace(trace_lines(events)).cache()
    cards, exchanges = trace.transactions(rows), trace.hsm_exchanges(rows)
    counts = {r.status: r.n_transactions for r in trace.status_counts(cards).collect()}
    # 625 of them are the stray lines, which change no status and no rule.
    assert rows.count() == 25842 + 625
    assert counts == {"OK": 6710, "ERROR": 2631, "UNKNOWN": 659}
    rules = trace.inconsistencies(cards, exchanges).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in rules} == {
        "R1": 1004,
        "R2": 2319,
        "R3": 500,
        "R4": 286,
    }


def test_units_and_facts(spark):
    rows = spark.createDataFrame(
        [(1, "s", "one a@b.de 3.5\n \nhttp://x.y/z"), (2, "s", None)],
        "doc_id long, source string, text string",
    )
    units = documents.text_units(rows).collect()
    assert [(r.unit_no, r.unit) for r in units] == [(1, "one a@b.de 3.5"), (3, "http://x.y/z")]
    found = sorted((r.kind, r.fact_no, r.value) for r in documents.facts(rows).collect())
    assert found == [
        ("email", 1, "a@b.de"),
        ("number", 1, "3.5"),
        ("url", 1, "http://x.y/z"),
    ]


def test_page_levels(spark):
    page = "<p>pre</p><h1>T<b>1</b></h1><p>a</p><p> </p><h1>T2</h1>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    units = documents.page_units(pages).collect()
    assert [(r.unit_no, r.unit) for r in units] == [(1, "pre"), (2, "T 1"), (3, "a"), (5, "T2")]
    sections = documents.page_sections(pages).collect()
    assert [(r.title, r.n_paragraphs) for r in sections] == [("", 1), ("T 1", 2), ("T2", 0)]


def test_unclosed_blocks(spark):
    page = "<article><h1>T<p><b>a<br><p>b</p><p>c\nd</article><footer>no</footer>"
    rows = [(1, "u", page), (2, "u", "<p>last"), (3, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    units = documents.page_units(pages).collect()
    assert [(r.doc_id, r.unit_no, r.unit) for r in units] == [
        (1, 1, "T"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c\nd"), (2, 1, "last"),
    ]
    sections = documents.page_sections(pages).collect()
    assert [(r.doc_id, r.title, r.n_paragraphs) for r in sections] == [
        (1, "", 0), (1, "T", 3), (2, "", 1),
    ]


def test_parts_language_and_entities(spark):
    page = (
        '<!DOCTYPE html><HTML class=x lang="de-AT"><head><title>A &amp;amp; B</title><style>p{}</style>'
        '<script>var t="<p>no</p>";</script></head><!-- <p>no</p> --><ul><li>one<li class=y>two</ul>stray'
        '<H2 id="h">C&#228;f&#xE9; &#x1F600;&unknown; &#0;</H2><p class="a">1 &lt; 2&nbsp;</p><pre>no</pre><p/>end'
    )
    rows = [(1, "u", page), (2, "v", None), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    units = documents.page_units(pages).orderBy("unit_no").collect()
    assert [(r.doc_id, r.lang, r.unit_no, r.part, r.unit) for r in units] == [
        (1, "de-at", 1, "title", "A &amp; B"),
        (1, "de-at", 2, "item", "one"),
        (1, "de-at", 3, "item", "two"),
        (1, "de-at", 4, "heading", "Cäfé \U0001f600&unknown; \ufffd"),
        (1, "de-at", 5, "paragraph", "1 < 2"),
        (1, "de-at", 6, "paragraph", "end"),
    ]
    sections = documents.page_sections(pages.where("page_id = 1")).orderBy("section_no").collect()
    assert [(r.title, r.n_paragraphs, r.n_items) for r in sections] == [
        ("", 0, 2), ("Cäfé \U0001f600&unknown; \ufffd", 2, 0),
    ]


def test_no_article_text_is_lost(spark):
    folder = TESTDATA / "sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = {}
    for r in documents.page_units(pages).orderBy("doc_id", "unit_no").collect():
        if r.part in ("heading", "paragraph"):
            found.setdefault(r.doc_id, []).append(r.unit)
    unclosed = 0
    for page in pages.collect():
        article = re.search("(?s)<article>(.*?)</article>", page.html)[1]
        unclosed += article.count("<p>") - article.count("</p>")
        words = html.unescape(re.sub("(?s)<[^>]*>", " ", article)).split()
        assert " ".join(found[page.page_id]).split() == words
    assert unclosed
    columns, expected = sql_rows(
        """SELECT doc_id, section_no, len(string_split(part, '<p>')) - 1 AS n_paragraphs
           FROM (SELECT page_id AS doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS section_no
                 FROM (SELECT page_id, string_split(html, '<h1>') AS parts FROM pages))""",
        folder,
    )
    sections = documents.page_sections(pages).select(*columns)
    assert canonical(columns, sections.collect()) == canonical(columns, expected)


@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_memory(stored, hot_rows):
    rows = documents.memory(stored, 2, hot_rows).where(F.col("conversation_id") == ID_A)
    found = [r.context for r in rows.orderBy("created_at").collect()]
    assert found == ["", "user: x", "user: x\nassistant"]
    state = documents.memory_state(stored, 2, hot_rows)
    texts = {r.conversation_id: r.context for r in state.collect()}
    assert texts[ID_A] == "assistant\nuser: x"


def bm25(documents_, question):
    """Straight from the formula."""
    words = {d: t.split() for d, t in documents_}
    mean = sum(map(len, words.values())) / len(words)
    scores = {}
    for token in set(question.split()):
        holders = [d for d, w in words.items() if token in w]
        idf = np.log(1 + (len(words) - len(holders) + 0.5) / (len(holders) + 0.5))
        for d in holders:
            tf = words[d].count(token)
            norm = tf + 1.2 * (0.25 + 0.75 * len(words[d]) / mean)
            scores[d] = scores.get(d, 0) + idf * tf * 2.2 / norm
    return sorted(scores, key=lambda d: (-round(scores[d], 6), d))


@pytest.mark.parametrize("limit", [0, 1000])
def test_lexical_matches_formula(spark, monkeypatch, limit):
    """With and without the broadcast of the query side."""
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_TOKENS", limit)
    texts = [(1, "a b a c"), (2, "b b"), (3, "c d e f g"), (4, ""), (5, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a c"), (8, "b z")], "item_id long, text string")
    rows = retrieval.lexical_top_k(docs, asked).orderBy("item_id", "rank").collect()
    for item, question in ((7, "a c"), (8, "b z")):
        assert [r.doc_id for r in rows if r.item_id == item] == bm25(texts, question)


def test_common_tokens_are_not_expanded(spark):
    """Documents share common tokens; rare ones decide. The rows added up are well
    below the pairs that share a token, and the ranks are those of the formula."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(400):
        words = [f"common{c}" for c in rng.integers(0, 4, rng.integers(20, 60))]
        words += [f"rare{c}" for c in rng.integers(0, 60, rng.integers(0, 4))]
        texts.append((i, " ".join(words)))
    asked = [(q, f"common0 common1 common2 rare{q} rare{q + 20} rare{q + 40}") for q in range(10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    questions = spark.createDataFrame([*asked, (99, "common0"), (98, "rare0"), (97, "none")], "item_id long, text string")
    rows = retrieval.lexical_top_k(docs, questions, k=5).collect()
    for item, question in [*asked, (99, "common0"), (98, "rare0"), (97, "none")]:
        mine = [d for _, d in sorted((r["rank"], r.doc_id) for r in rows if r.item_id == item)]
        assert mine == bm25(texts, question)[:5]
    tokens = questions.where("item_id < 90")
    vocabulary = spark.createDataFrame([(f"{w}{i}",) for w, n in (("common", 4), ("rare", 60)) for i in range(n)], "token string")
    postings, bounds = retrieval.impacts(retrieval.token_counts(docs, vocabulary, "doc_id"), "doc_id")
    terms = retrieval.asked_tokens(tokens, "item_id").join(bounds, "token")
    scored, partial = retrieval.bounded_scores(postings, terms, "item_id", "doc_id", 5)
    sharing = postings.join(terms.select("item_id", "token").distinct(), "token").select("item_id", "doc_id").distinct()
    assert partial.count() < sharing.count() / 3
    assert scored.count() < sharing.count() / 5


@pytest.mark.parametrize("triples", [1, 50, 1 << 20])
def test_tasks_keep_the_best_documents_only(spark, monkeypatch, triples):
    """A task gives k documents per question on, however many share a token or are
    copies; ids on several rows are one document."""
    monkeypatch.setattr(retrieval, "TRIPLES_AT_ONCE", triples)
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{c}" for c in rng.integers(0, 9, rng.integers(0, 12)))) for i in range(300)]
    texts += [(i, "w1 w2 w3") for i in range(300, 400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = [("x", "w1 w2 w2"), ("y", "w3 w4 w5 none"), ("z", "none")]
    questions = spark.createDataFrame(asked, "item_id string, text string")
    tokens = retrieval.asked_tokens(questions, "item_id").distinct()
    assert retrieval.scanned_scores(docs, tokens, "item_id", "doc_id", 4).count() <= 3 * 4 * 2
    rows = retrieval.lexical_top_k(docs, questions, k=4).collect()
    for item, question in asked:
        mine = [d for _, d in sorted((r["rank"], r.doc_id) for r in rows if r.item_id == item)]
        assert mine == bm25(texts, question)[:4]


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_of_one_id_are_one_document(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_TOKENS", limit)
    rows = [(1, "a"), (1, "a"), (1, "b b"), (2, "a b"), (3, None), (3, "b"), (4, "z"), (4, "y"), (5, "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    questions = spark.createDataFrame([(7, "a b"), (8, "b")], "item_id long, text string")
    found = retrieval.lexical_top_k(docs, questions).collect()
    ranks = {i: [d for _, d in sorted((r["rank"], r.doc_id) for r in found if r.item_id == i)] for i in (7, 8)}
    assert ranks == {7: [1, 2, 5, 3], 8: [1, 3, 2]}


@pytest.mark.parametrize(("block_queries", "cell_numbers"), [(3, 16), (3, 1 << 23), (8192, 16), (8192, 1 << 23)])
def test_vector_matches_brute_force(spark, monkeypatch, block_queries, cell_numbers):
    """With one and with many cells, equal scores, odd widths and bad elements."""
    monkeypatch.setattr(retrieval, "SCORED_AT_ONCE", 2)
    random = np.random.default_rng(5)
    vectors = random.integers(-2, 3, (60, 4)).astype(float)
    passages = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)]
        + [(60, None), (61, [1.0]), (62, [1.0, None, 1.0, 1.0]), (63, [float("nan")] * 4), (64, [])],
        "vec_id long, embedding array<float>",
    )
    questions = passages.where("vec_id < 9 OR vec_id > 59").withColumnRenamed("vec_id", "item_id")
    questions = questions.unionByName(
        spark.createDataFrame([(70, [1.0, 2.0]), (71, None)], "item_id long, embedding array<float>")
    )
    group = f"planned-{block_queries}-{cell_numbers}"
    spark.sparkContext.setJobGroup(group, "vector_top_k")
    found = retrieval.vector_top_k(passages, questions, "item_id", "vec_id", 5, block_queries, cell_numbers)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    rows = found.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.item_id for r in rows} == set(range(9))
    for item in range(9):
        scores = vectors @ vectors[item]
        others = [i for i in range(60) if i != item]
        best = sorted(others, key=lambda i: (-scores[i], i))[:5]
        mine = sorted((r.rank, r.vec_id) for r in rows if r.item_id == item)
        assert [vec for _, vec in mine] == best
    widths = retrieval.vector_widths(passages, questions).orderBy("width").collect()
    assert [tuple(r) for r in widths] == [(-1, 1, 2), (0, 1, 1), (1, 1, 1), (2, 0, 1), (4, 62, 11)]
    assert retrieval.vector_top_k(passages.where("false"), questions).collect() == []


def test_fusion(spark):
    schema = "item_id long, doc_id long, rank long"
    lexical = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    vector = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    rows = retrieval.fuse(lexical, vector).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [11, 10, 12]
    assert (rows[1].lexical_rank, rows[1].vector_rank) == (1, None)
