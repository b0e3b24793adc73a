"""The registered queries: whole tables of a data folder in, one result out.

Results are flat, for comparison across engines: times as text, arrays joined,
absent text empty. The operators themselves keep typed and nested columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions.text import time_text
from casefile.operators import answers, chat, documents, retrieval, trace, uploads
from casefile.operators.groups import dealt_by
from casefile.schemas import CONVERSATION_TURN, EVENT
from casefile.session import work_dir
from casefile.sources import sinks, views
from casefile.sources.tables import read_table, stream_table
from casefile.streaming import messages as message_stream
from casefile.streaming import pairing

Query = Callable[[SparkSession, str], DataFrame]

PAIR_WITHIN = "10 seconds"
PAIR_DELAY = "1 minute"
EVENTS_PER_TASK = 200_000


def _times_as_text(rows: DataFrame) -> DataFrame:
    times = [n for n, kind in rows.dtypes if kind == "timestamp"]
    return rows.withColumns({n: time_text(F.col(n)) for n in times}) if times else rows


def _filled(rows: DataFrame, *names: str) -> DataFrame:
    empty = F.lit("")
    return rows.withColumns(
        {n: F.coalesce(F.col(n).cast("string"), empty) for n in names}
    )


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return views.conv_messages(_turns(spark, folder)).drop("conv_id", "turn")


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    return views.conv_heads(_turns(spark, folder))


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    return views.incoming_messages(_turns(spark, folder))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def _uploads(spark: SparkSession, folder: str) -> DataFrame:
    return views.uploads(_documents(spark, folder))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return views.answers(_documents(spark, folder))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = answers.split_malformed(answers.parse_answers(_bodies(spark, folder)))
    return good


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return trace.parse_trace(views.trace_lines(read_table(spark, folder, "events")))


def _stored_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed trace, written once for queries that read it several times. Events
    are dealt out first: a small file of them is a long trace."""
    events = read_table(spark, folder, "events")
    parts = max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_PER_TASK))
    lines = views.trace_lines(events.select("event_id", "ts", "user_id", "event_type").repartition(parts))
    return sinks.materialized(trace.parse_trace(lines), "trace")


def _trace_issues(parsed: DataFrame) -> DataFrame:
    return trace.inconsistencies(
        trace.transactions(parsed), trace.hsm_exchanges(parsed)
    )


def _benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark")


# Conversations and messages


def conversation_history(spark: SparkSession, folder: str) -> DataFrame:
    return _times_as_text(chat.history(_heads(spark, folder)))


def conversation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    targets = _incoming(spark, folder).select(
        F.col("conversation_id").alias("requested_id")
    )
    found = chat.lookup_status(targets.distinct(), _heads(spark, folder))
    return _filled(found, "title", "agent")


def conversation_create_status(spark: SparkSession, folder: str) -> DataFrame:
    requests = views.new_conversations(_turns(spark, folder))
    return _times_as_text(_filled(chat.creation_status(requests), "id"))


def message_timeline(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.timelines(_messages(spark, folder))
    shown = rows.select(
        "conversation_id",
        "position",
        "id",
        "role",
        "content",
        F.size("attachments").cast("bigint").alias("n_attachments"),
        "created_at",
    )
    return _times_as_text(shown)


def message_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = chat.message_groups(chat.timelines(_messages(spark, folder)))
    # The client appends its own notice to the stored messages.
    notice = F.struct(
        (F.size("messages") + 1).cast("bigint").alias("position"),
        F.lit("local").alias("id"),
        F.lit("assistant").alias("role"),
        F.lit("The backend request failed.").alias("content"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    shown = chat.append_local(groups, notice)
    text = F.transform(
        "messages",
        lambda m: F.concat_ws(":", m["role"], m["content"]),
    )
    return shown.select(
        "conversation_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(text, "|").alias("messages"),
    )


def message_append_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.append_status(_incoming(spark, folder), _heads(spark, folder))
    return rows.select("id", "conversation_id", "role", "status", "detail")


def conversation_touch(spark: SparkSession, folder: str) -> DataFrame:
    heads = _heads(spark, folder)
    accepted = chat.accepted_messages(_incoming(spark, folder), heads)
    touched = chat.touch(heads, chat.last_activity(accepted))
    return _times_as_text(touched.select("id", "created_at", "updated_at"))


def conversation_delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    requested = views.delete_requests(_turns(spark, folder))
    heads, rows = chat.delete_cascade(
        requested, _heads(spark, folder), _messages(spark, folder)
    )
    left = heads.select(F.lit("conversation").alias("kind"), "id")
    return left.unionByName(rows.select(F.lit("message").alias("kind"), "id"))


def conversation_delete_status(spark: SparkSession, folder: str) -> DataFrame:
    requested = views.delete_requests(_turns(spark, folder))
    return chat.deletion_status(
        requested, _heads(spark, folder), _messages(spark, folder)
    )


def orphan_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.orphans(_incoming(spark, folder), _heads(spark, folder))
    return rows.select("id", "conversation_id", "role")


def agent_lookup(spark: SparkSession, folder: str) -> DataFrame:
    stored = _heads(spark, folder).select("id", "agent")
    created = chat.created_conversations(views.new_conversations(_turns(spark, folder)))
    rows = chat.with_agent(stored.unionByName(created.select("id", "agent")))
    return rows.select("id", "agent", "agent_name", "agent_description", "icon")


def latest_roles(spark: SparkSession, folder: str) -> DataFrame:
    return chat.latest_value(_messages(spark, folder), "conversation_id", "role", "created_at", "id")


def conversation_memory(spark: SparkSession, folder: str) -> DataFrame:
    return _times_as_text(documents.memory(_messages(spark, folder)))


def conversation_memory_state(spark: SparkSession, folder: str) -> DataFrame:
    return _times_as_text(documents.memory_state(_messages(spark, folder)))


def question_intent(spark: SparkSession, folder: str) -> DataFrame:
    return documents.question_intents(_messages(spark, folder))


def resolved_question(spark: SparkSession, folder: str) -> DataFrame:
    return documents.resolved_questions(_messages(spark, folder))


def chat_request_status(spark: SparkSession, folder: str) -> DataFrame:
    requests = views.new_conversations(_turns(spark, folder)).select(
        "conv_id", "agent", F.col("title").alias("question")
    )
    return chat.chat_request_status(requests)


def question_summary(spark: SparkSession, folder: str) -> DataFrame:
    asked = views.questions(_turns(spark, folder))
    summary = trace.agent_summary(F.col("agent"), F.col("question"))
    return asked.select("conv_id", "agent", summary.alias("summary"))


# Uploads


def upload_file_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = uploads.file_errors(_uploads(spark, folder))
    shown = rows.select("request_id", "ordinal", "filename", "extension", "error")
    return _filled(shown, "error")


def upload_batch_status(spark: SparkSession, folder: str) -> DataFrame:
    return uploads.batch_status(_uploads(spark, folder))


def upload_request_status(spark: SparkSession, folder: str) -> DataFrame:
    return uploads.request_status(views.upload_requests(_documents(spark, folder)))


def upload_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = uploads.manifest(uploads.accepted_files(_uploads(spark, folder)))
    files = F.transform(
        "files",
        lambda f: F.concat_ws(
            ":", f["filename"], f["content_type"], f["size"].cast("string")
        ),
    )
    return rows.withColumn("files", F.array_join(files, "|"))


def document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1 over stored texts: their size in bytes."""
    return _documents(spark, folder).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")
    )


def attachment_lists(spark: SparkSession, folder: str) -> DataFrame:
    lists = uploads.attachment_lists(
        uploads.accepted_files(_uploads(spark, folder)), F.col("request_id") % 3
    )
    items = F.transform(
        "attachments",
        lambda a: F.concat_ws(":", a["name"], a["size"].cast("string"), a["type"]),
    )
    return lists.withColumn("attachments", F.array_join(items, "|"))


def upload_size_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = uploads.with_size_check(_uploads(spark, folder))
    return rows.select("request_id", "ordinal", "size", "size_text", "outcome")


def upload_size_messages(spark: SparkSession, folder: str) -> DataFrame:
    return uploads.size_messages(_uploads(spark, folder))


# Answers


def answer_sections(spark: SparkSession, folder: str) -> DataFrame:
    return answers.sections(_answers(spark, folder), "doc_id")


def answer_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = answers.split_malformed(answers.parse_answers(_bodies(spark, folder)))
    return bad.select("doc_id", "malformed")


def answer_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = answers.validation(_bodies(spark, folder), "doc_id")
    return rows.withColumn("faults", F.array_join("faults", ","))


def answer_variant_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = answers.variant_paths(_bodies(spark, folder), "doc_id")
    return _filled(paths, "summary", "severity", "source", "page")


def answer_issues(spark: SparkSession, folder: str) -> DataFrame:
    return answers.issues(_answers(spark, folder), "doc_id")


def answer_references(spark: SparkSession, folder: str) -> DataFrame:
    return answers.references(_answers(spark, folder), "doc_id")


def error_messages(spark: SparkSession, folder: str) -> DataFrame:
    bodies = views.api_errors(read_table(spark, folder, "events"))
    return answers.error_messages(bodies, "event_id")


# Traces


def trace_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = _times_as_text(_parsed(spark, folder))
    return _filled(rows, *[c for c in rows.columns if c != "ts"])


def trace_transactions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _times_as_text(trace.transactions(_stored_trace(spark, folder)))
    return _filled(rows, *[c for c in rows.columns if c != "n_lines"])


def trace_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trace.status_counts(trace.transactions(_stored_trace(spark, folder)))


def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    parsed = dealt_by(_stored_trace(spark, folder), "rrn")
    return trace.trace_summary(
        parsed, trace.transactions(parsed), _trace_issues(parsed)
    )


def trace_story(spark: SparkSession, folder: str) -> DataFrame:
    return _times_as_text(trace.story(_stored_trace(spark, folder)).drop("part"))


def hsm_exchanges(spark: SparkSession, folder: str) -> DataFrame:
    rows = _times_as_text(trace.hsm_exchanges(_stored_trace(spark, folder)).drop("replied"))
    return _filled(rows, "reply", "reply_ts", "hsm_return")


def trace_inconsistencies(spark: SparkSession, folder: str) -> DataFrame:
    return _trace_issues(dealt_by(_stored_trace(spark, folder), "rrn"))


def response_code_meaning(spark: SparkSession, folder: str) -> DataFrame:
    rows = trace.code_meanings(_parsed(spark, folder), views.codes(spark))
    shown = rows.select(
        "rrn", "kind", "response_code", "kind_meaning", "response_meaning"
    )
    return _filled(shown, "response_code")


def _told_and_cards(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parsed = _stored_trace(spark, folder)
    cards = trace.with_rules(trace.transactions(parsed), trace.hsm_exchanges(parsed))
    return trace.story_pages(trace.story(parsed)), cards


def trace_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = trace.report(*_told_and_cards(spark, folder))
    shown = rows.select(
        "rrn",
        "first_step",
        "card",
        "status",
        "response_code",
        "n_lines",
        F.array_join("rules", ",").alias("rules"),
        F.array_join("story", " ").alias("story"),
    )
    return _filled(shown, "card", "response_code")


def structured_answer(spark: SparkSession, folder: str) -> DataFrame:
    rows = trace.structured_answers(*_told_and_cards(spark, folder))
    titles = F.transform(
        "answer.issues", lambda i: F.concat_ws(":", i["severity"], i["title"])
    )
    return rows.select(
        "conversation_id",
        "first_step",
        "agent",
        F.col("answer.summary").alias("summary"),
        F.array_join("answer.story", " ").alias("story"),
        F.array_join(titles, "|").alias("issues"),
        F.array_join("answer.recommendations", "|").alias("recommendations"),
    )


def structured_answer_evidence(spark: SparkSession, folder: str) -> DataFrame:
    told, cards = _told_and_cards(spark, folder)
    evidence = retrieval.rule_evidence(_documents(spark, folder))
    rows = trace.structured_answers(told, cards, evidence)
    details = F.transform("answer.issues", lambda i: F.concat_ws(":", i["title"], i["detail"]))
    sources = F.transform("answer.references", lambda r: r["source"])
    return rows.select(
        "conversation_id",
        "first_step",
        F.array_join(details, "|").alias("issues"),
        F.array_join(sources, "|").alias("sources"),
    )


def report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The report written as JSON and TXT, and read from both."""
    report = trace.report(*_told_and_cards(spark, folder))
    target = work_dir(spark, "export")
    sinks.export_report(report, target, "rrn")
    read = [
        sinks.read_report(spark, target, report.schema, kind).select(
            F.lit(kind).alias("format"),
            "rrn",
            "card",
            time_text(F.col("request_ts")).alias("request_ts"),
            "status",
            "n_lines",
            F.array_join("rules", ",").alias("rules"),
            F.array_join("story", " ").alias("story"),
        )
        for kind in ("json", "txt")
    ]
    return _filled(read[0].unionByName(read[1]), "card", "request_ts")


# Documents and retrieval


def content_units(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents.text_units(_documents(spark, folder))
    texts = texts.withColumns({"lang": F.lit(""), "part": F.lit("line")})
    html = documents.page_units(read_table(spark, folder, "pages"))
    return texts.withColumn("kind", F.lit("document")).unionByName(
        html.withColumn("kind", F.lit("page"))
    )


def _section_passages(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.section_top_k(content_units(spark, folder), _benchmark(spark, folder))


def section_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(_section_passages(spark, folder), "source")


def documentation_answer(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.documentation_answers(
        _benchmark(spark, folder), _section_passages(spark, folder)
    )
    place = F.transform(
        "citations",
        lambda c: F.concat_ws(":", c["kind"], c["doc_id"].cast("string"), c["unit_no"].cast("string")),
    )
    return rows.select(
        "item_id",
        "agent",
        "intent",
        F.col("answer.summary").alias("summary"),
        F.array_join("answer.story", "\n").alias("story"),
        F.array_join(F.transform("answer.references", lambda r: r["source"]), "|").alias("sources"),
        F.array_join(place, "|").alias("citations"),
    )


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    return documents.page_sections(read_table(spark, folder, "pages"))


def document_facts(spark: SparkSession, folder: str) -> DataFrame:
    return documents.facts(_documents(spark, folder))


def function_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return documents.function_catalog(documents.text_units(_documents(spark, folder)))


def _lexical(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.lexical_top_k(
        _documents(spark, folder), _benchmark(spark, folder)
    )


def _question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A question's vector is the embedding with its id (FIXTURES section 3.10)."""
    items = _benchmark(spark, folder).select(F.col("item_id").alias("vec_id"))
    questions = read_table(spark, folder, "embeddings").join(items, "vec_id", "left_semi")
    return questions.select(F.col("vec_id").alias("item_id"), "embedding")


def _vector(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return retrieval.vector_top_k(vectors, _question_vectors(spark, folder))


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _lexical(spark, folder)


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(spark, folder)


def vector_widths(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return retrieval.vector_widths(vectors, _question_vectors(spark, folder))


def evidence_fusion(spark: SparkSession, folder: str) -> DataFrame:
    vector = _vector(spark, folder).withColumnRenamed("vec_id", "doc_id")
    fused = retrieval.fuse(_lexical(spark, folder), vector)
    cited = retrieval.cited(fused, _documents(spark, folder))
    return _filled(cited, "lexical_rank", "vector_rank", "source")


def anomaly_evidence(spark: SparkSession, folder: str) -> DataFrame:
    issues = _trace_issues(_stored_trace(spark, folder))
    rows = retrieval.anomaly_evidence(issues, _documents(spark, folder))
    shown = rows.select("rrn", "xid", "rule", "doc_id", "source")
    return _filled(shown, "doc_id", "source")


# Streams


def stream_message_append(spark: SparkSession, folder: str) -> DataFrame:
    """Every message is sent twice; it is stored once."""

    def incoming() -> DataFrame:
        turns = stream_table(spark, folder, "conversations", CONVERSATION_TURN)
        return views.incoming_messages(turns)

    sent = incoming().unionByName(incoming())
    target = work_dir(spark, "append")
    query = message_stream.append_messages(sent, lambda: _heads(spark, folder), target)
    query.awaitTermination()
    schema = _incoming(spark, folder).schema
    rows = message_stream.read_appended(spark, target, schema)
    shown = rows.select("id", "conversation_id", "role", "content", "created_at")
    return _times_as_text(shown)


def stream_conversation_touch(spark: SparkSession, folder: str) -> DataFrame:
    def heads() -> DataFrame:
        return _heads(spark, folder)

    turns = stream_table(spark, folder, "conversations", CONVERSATION_TURN)
    target = work_dir(spark, "touch")
    query = message_stream.append_messages(
        views.incoming_messages(turns), heads, target
    )
    query.awaitTermination()
    touched = message_stream.read_touched(spark, target, heads())
    return _times_as_text(touched.select("id", "created_at", "updated_at"))


def stream_trace_pairing(spark: SparkSession, folder: str) -> DataFrame:
    def parsed() -> DataFrame:
        events = stream_table(spark, folder, "events", EVENT)
        return trace.parse_trace(views.trace_lines(events))

    paired = pairing.pair_reversals(parsed(), parsed(), PAIR_WITHIN, PAIR_DELAY)
    target = work_dir(spark, "pairs")
    pairing.run_pairing(paired, target).awaitTermination()
    rows = pairing.reconcile(spark, target, _parsed(spark, folder), PAIR_WITHIN)
    shown = _times_as_text(rows.select("rrn", "request_ts", "reversal_ts", "found"))
    return _filled(shown, "reversal_ts")


QUERIES: tuple[Query, ...] = (
    conversation_history,
    conversation_lookup,
    conversation_create_status,
    message_timeline,
    message_groups,
    message_append_status,
    conversation_touch,
    conversation_delete_cascade,
    conversation_delete_status,
    orphan_messages,
    agent_lookup,
    latest_roles,
    conversation_memory,
    conversation_memory_state,
    question_intent,
    resolved_question,
    chat_request_status,
    question_summary,
    upload_file_errors,
    upload_batch_status,
    upload_request_status,
    upload_manifest,
    document_sizes,
    attachment_lists,
    upload_size_split,
    upload_size_messages,
    answer_sections,
    answer_quarantine,
    answer_validation,
    answer_variant_paths,
    answer_issues,
    answer_references,
    error_messages,
    trace_parse,
    trace_transactions,
    trace_status_counts,
    trace_summary,
    trace_story,
    hsm_exchanges,
    trace_inconsistencies,
    response_code_meaning,
    trace_report,
    structured_answer,
    structured_answer_evidence,
    report_roundtrip,
    content_units,
    document_sections,
    document_facts,
    section_topk,
    documentation_answer,
    function_catalog,
    lexical_topk,
    vector_topk,
    vector_widths,
    evidence_fusion,
    anomaly_evidence,
    stream_message_append,
    stream_conversation_touch,
    stream_trace_pairing,
)


def registered() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}
