"""Views that give the data folder's tables the record shapes of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions.ids import hex_id, message_id
from casefile.functions.text import auto_title, time_text

EPOCH = "2024-01-01 00:00:00"
UNKNOWN_ID_OFFSET = 10_000_000
# Holds every bigint, so no two events share a number.
RRN_DIGITS = 19


def _pick(number: Column, *choices: str) -> Column:
    """The choice at position ``number`` modulo their count."""
    items = F.array(*[F.lit(c) for c in choices])
    return F.element_at(items, (number % len(choices) + 1).cast("int"))


def conv_messages(turns: DataFrame) -> DataFrame:
    seconds = F.col("conv_id") * 60 + F.col("turn")
    interval = F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return turns.select(
        message_id(F.col("conv_id"), F.col("turn")).alias("id"),
        hex_id(F.col("conv_id")).alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("structured"),
        F.lit(None)
        .cast("array<struct<name:string,size:bigint,type:string>>")
        .alias("attachments"),
        (F.lit(EPOCH).cast("timestamp") + interval).alias("created_at"),
        "conv_id",
        "turn",
    )


def conv_heads(turns: DataFrame) -> DataFrame:
    """One row per conversation; the title comes from the first user turn."""
    messages = conv_messages(turns).select(
        "conversation_id",
        "conv_id",
        "created_at",
        F.when(
            F.col("role") == "user",
            F.struct("turn", auto_title(F.col("content")).alias("title")),
        ).alias("opening"),
    )
    heads = messages.groupBy("conv_id", F.col("conversation_id").alias("id")).agg(
        F.min("opening").alias("opening"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )
    agent = F.when(F.col("conv_id") % 5 != 0, _pick(F.col("conv_id"), "documentation", "log"))
    return heads.select(
        "id",
        F.col("opening.title").alias("title"),
        agent.alias("agent"),
        "created_at",
        "updated_at",
    )


def incoming_messages(turns: DataFrame) -> DataFrame:
    """Messages posted again a day later, some to bad or unknown conversations."""
    digit = F.col("conv_id") % 10
    own = F.col("conversation_id")
    target = (
        F.when(digit == 3, F.concat(F.lit("bad-"), F.substring(own, 6, 19)))
        .when(digit == 7, hex_id(F.col("conv_id") + UNKNOWN_ID_OFFSET))
        .otherwise(own)
    )
    later = F.col("created_at") + F.expr("interval 1 day")
    return (
        conv_messages(turns)
        .withColumns({"conversation_id": target, "created_at": later})
        .drop("conv_id", "turn")
    )


def delete_requests(turns: DataFrame) -> DataFrame:
    """One request per conversation: its own id if it holds a system turn, a
    malformed id if it has no agent, else an unknown id."""
    conversations = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("has_system")
    )
    own = hex_id(F.col("conv_id"))
    target = (
        F.when(F.col("has_system") == 1, own)
        .when(F.col("conv_id") % 5 == 0, F.concat(F.lit("bad-"), F.substring(own, 6, 19)))
        .otherwise(hex_id(F.col("conv_id") + UNKNOWN_ID_OFFSET))
    )
    return conversations.select(target.alias("requested_id"))


def new_conversations(turns: DataFrame) -> DataFrame:
    lengths = F.array(*[F.lit(n) for n in (0, 1, 40, 100, 101)])
    length = F.element_at(lengths, (F.col("conv_id") % 5 + 1).cast("int"))
    return turns.where("turn = 0").select(
        "conv_id",
        F.col("text").substr(F.lit(1), length).alias("title"),
        _pick(F.col("conv_id"), "documentation", "log", "other").alias("agent"),
        F.lit(EPOCH).cast("timestamp").alias("created_at"),
    )


def questions(turns: DataFrame) -> DataFrame:
    """The first turn of every conversation as a question to its agent."""
    agent = _pick(F.col("conv_id"), "documentation", "log")
    return turns.where("turn = 0").select("conv_id", agent.alias("agent"), F.col("text").alias("question"))


def uploads(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    case = doc % 20
    kind = _pick(doc, "pdf", "doc", "docx", "xls", "xlsx", "txt", "log")
    plain = F.concat(F.lit("doc"), doc.cast("string"), F.lit(".v1."), kind)
    filename = (
        F.when(case == 0, F.lit(""))
        .when(case == 1, F.concat(F.lit("noext"), doc.cast("string")))
        .when(case == 2, F.concat(F.lit("tool"), doc.cast("string"), F.lit(".EXE")))
        .when(case == 3, F.concat(F.lit("x"), doc.cast("string"), F.lit(".")))
        .when(doc % 4 == 0, F.upper(plain))
        .otherwise(plain)
    )
    request = F.call_function("div", doc, F.lit(3))
    return documents.select(
        request.alias("request_id"),
        (doc % 3).alias("ordinal"),
        _pick(request, "documentation", "log").alias("agent"),
        filename.alias("filename"),
        F.concat(F.lit("application/"), kind).alias("content_type"),
        (F.col("n_chars") * 2000).alias("size"),
    )


def upload_requests(documents: DataFrame) -> DataFrame:
    """The uploads, every third batch for an agent that does not exist."""
    agent = _pick(F.col("request_id"), "documentation", "log", "other")
    return uploads(documents).withColumn("agent", agent)


def answers(documents: DataFrame) -> DataFrame:
    """Stored answers as JSON text."""
    doc = F.col("doc_id")
    story = (
        F.when(doc % 11 == 0, F.lit(None))
        .when(doc % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.split("text", "\n"))
    )
    issue = F.struct(
        _pick(doc, "info", "warning", "error", "critical").alias("severity"),
        F.concat(F.lit("issue "), doc.cast("string")).alias("title"),
        F.when(doc % 2 == 0, F.concat(F.lit("detail "), doc.cast("string"))).alias(
            "detail"
        ),
    )
    reference = F.struct(
        F.col("source"), F.when(doc % 3 != 0, doc % 90).cast("int").alias("page")
    )
    body = F.to_json(
        F.struct(
            F.col("text").alias("summary"),
            story.alias("story"),
            F.array(issue).alias("issues"),
            F.array(reference).alias("references"),
        )
    )
    broken = F.lit('{"summary":')
    return documents.select(
        "doc_id", F.when(doc % 50 == 49, broken).otherwise(body).alias("body")
    )


def trace_lines(events: DataFrame) -> DataFrame:
    """The payment trace, one text line per row."""
    event = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    rrn = F.concat(F.lit("FLD(037)="), F.lpad(event.cast("string"), RRN_DIGITS, "0"))

    def after(millis: Column | int) -> Column:
        value = F.lit(millis) if isinstance(millis, int) else millis
        return F.timestamp_micros(F.unix_micros(ts) + value * 1000)

    def line(time: Column, *texts: str | Column) -> Column:
        parts = [F.lit(t) if isinstance(t, str) else t for t in texts]
        return F.concat(time_text(time), F.lit(" "), *parts)

    path = (
        F.when(F.col("event_type") == "error", "rev")
        .when((F.col("event_type") == "signup") & (event % 3 == 0), "lone")
        .when((F.col("event_type") == "purchase") & (event % 5 == 0), "decl")
        .otherwise("ok")
    )
    code = F.when(path == "decl", F.lit("05")).otherwise(F.lit("00"))
    card = F.lpad(F.col("user_id").cast("string"), 12, "0")
    request = line(
        ts, "MTI=0100 FLD(002)=4000", card, " FLD(003)=000000 ", rrn
    )
    response = line(
        after((event * 37) % 4000), "MTI=0110 ", rrn, " FLD(039)=", code
    )
    reversal_code = F.when(event % 2 == 0, F.lit(" FLD(039)=00")).otherwise(F.lit(""))
    reversal = line(after(5000), "MTI=0400 ", rrn, reversal_code)
    command = line(after(2), "HSM> cmd=CA xid=1 ", rrn)
    result = F.when(event % 28 == 0, F.lit("15")).otherwise(F.lit("00"))
    reply = line(after(3), "HSM< rsp=CB xid=1 rc=", result, F.lit(" "), rrn)
    # A stray line of an earlier exchange under the same number.
    early = line(after(-1000), "MTI=0110 ", rrn, " FLD(039)=05")
    lines = F.array(
        F.when(event % 16 == 5, early),
        request,
        F.when(path != "lone", response),
        F.when(path == "rev", reversal),
        F.when(event % 4 == 0, command),
        F.when((event % 4 == 0) & (event % 20 != 0), reply),
    )
    return events.select(F.explode_outer(lines).alias("line")).where("line IS NOT NULL")


def codes(spark: SparkSession) -> DataFrame:
    """The code dimension: five fixed rows."""
    rows = [
        ("00", "response", "approved"),
        ("05", "response", "declined"),
        ("0100", "mti", "authorization request"),
        ("0110", "mti", "authorization response"),
        ("0400", "mti", "reversal request"),
    ]
    return spark.createDataFrame(rows, "code string, kind string, meaning string")


def api_errors(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    number = event.cast("string")
    body = (
        F.when(
            event % 5 == 0,
            F.concat(F.lit('{"detail":"d'), number, F.lit('","message":"m"}')),
        )
        .when(event % 5 == 1, F.concat(F.lit('{"message":"m'), number, F.lit('"}')))
        .when(
            event % 5 == 2,
            F.concat(F.lit('{"detail":"","message":"m'), number, F.lit('"}')),
        )
        .when(event % 5 == 3, F.lit("{}"))
        .otherwise(F.lit("not json"))
    )
    return events.select("event_id", body.alias("body"))
