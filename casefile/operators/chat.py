"""Conversations and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions.ids import is_object_id, stable_id
from casefile.operators.groups import HOT_ROWS, number_rows

# List caps, defaults, enums, bounds and messages of the API.
HISTORY_LIMIT = 100
TIMELINE_LIMIT = 500
DEFAULT_AGENT = "documentation"
ROLES = ("user", "assistant")
MAX_TITLE = 100
INVALID_ID = "Invalid conversation ID"
NOT_FOUND = "Conversation not found"

# The agents that the client knows, and the icon of an unknown one.
AGENTS = (
    (
        "documentation",
        "Documentation Agent",
        "Analyze technical specifications (PDF, Word and Excel) and answer "
        "questions based on their content.",
        "FileText",
    ),
    (
        "log",
        "Log Analysis Agent",
        "Analyze authorization logs, reconstruct transaction flows, detect "
        "non-conformities and provide diagnostic recommendations.",
        "Activity",
    ),
)
DEFAULT_ICON = "FileText"


def serialize_conversations(heads: DataFrame) -> DataFrame:
    """PRJ-1, PRJ-8."""
    agent = F.coalesce("agent", F.lit(DEFAULT_AGENT)).alias("agent")
    return heads.select("id", "title", agent, "created_at", "updated_at")


def serialize_messages(messages: DataFrame) -> DataFrame:
    """PRJ-2, PRJ-9: every column kept, null content and attachments filled."""
    return messages.withColumns(
        {
            "content": F.coalesce("content", F.lit("")),
            "attachments": F.coalesce("attachments", F.array()),
        }
    )


def history(heads: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """SRT-1, SRT-3: the conversations touched last."""
    rows = serialize_conversations(heads)
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit)


def find_conversation(heads: DataFrame, conversation_id: str) -> DataFrame:
    """FIL-1: one conversation; the filter reaches the scan."""
    return serialize_conversations(heads.where(F.col("id") == conversation_id.lower()))


def conversation_messages(
    messages: DataFrame, conversation_id: str, limit: int = TIMELINE_LIMIT
) -> DataFrame:
    """FIL-2, SRT-2: one conversation, oldest message first."""
    rows = messages.where(F.col("conversation_id") == conversation_id.lower())
    return serialize_messages(rows.orderBy("created_at", "id").limit(limit))


def timelines(
    messages: DataFrame, limit: int = TIMELINE_LIMIT, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """WIN-1: the same for every conversation, with each message's position."""
    first = number_rows(
        messages, "conversation_id", "created_at", ["id"], "position", hot_rows,
        limit=limit,
    )
    return serialize_messages(first)


def message_groups(timeline: DataFrame) -> DataFrame:
    """AGG-4: the messages of each conversation as one array. The input is a
    timeline, so an array holds at most its limit."""
    entry = F.struct("position", "id", "role", "content", "created_at")
    groups = timeline.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(entry)).alias("messages")
    )
    return groups


def append_local(groups: DataFrame, local: Column) -> DataFrame:
    """SET-1: an unsaved message shown after the stored ones."""
    return groups.withColumn("messages", F.concat("messages", F.array(local)))


def stamped(rows: DataFrame) -> DataFrame:
    """DAT-1, PRJ-5: gives new rows the time of the job, the same for all."""
    return rows.withColumn("created_at", F.current_timestamp())


def creation_status(requests: DataFrame) -> DataFrame:
    """FIL-6, STR-7, PRJ-5: 201 or 422 per request, with the id and the one
    instant of the rows to insert. Any agent text is accepted."""
    valid = F.coalesce(F.length("title").between(1, MAX_TITLE), F.lit(False))
    new_id = stable_id(F.col("conv_id"), F.col("title"), F.col("created_at"))
    return requests.select(
        "*",
        F.when(valid, F.lit(201)).otherwise(F.lit(422)).alias("status"),
        F.when(valid, new_id).alias("id"),
        F.coalesce("agent", F.lit(DEFAULT_AGENT)).alias("stored_agent"),
    )


def chat_request_status(requests: DataFrame) -> DataFrame:
    """FIL-5, FIL-6: 422 for an agent that is none of the catalog's or a question
    without a character, with the field at fault; else 200."""
    agent = F.coalesce(F.col("agent").isin(*[a[0] for a in AGENTS]), F.lit(False))
    question = F.coalesce(F.length("question") >= 1, F.lit(False))
    fault = F.when(~agent, F.lit("agent")).when(~question, F.lit("question")).otherwise(F.lit(""))
    return requests.withColumn("fault", fault).withColumn(
        "status", F.when(F.col("fault") == "", F.lit(200)).otherwise(F.lit(422))
    )


def created_conversations(requests: DataFrame) -> DataFrame:
    """SNK-1: the rows to append."""
    accepted = creation_status(requests).where("status = 201")
    return accepted.select(
        "id",
        "title",
        F.col("stored_agent").alias("agent"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def lookup_status(requested: DataFrame, heads: DataFrame) -> DataFrame:
    """FIL-1, FIL-3, FIL-4 for a table of requested ids."""
    known = serialize_conversations(heads).select(
        F.col("id").alias("known_id"), "title", "agent"
    )
    wanted = requested.withColumn("lookup_id", F.lower("requested_id"))
    joined = wanted.join(known, F.col("lookup_id") == F.col("known_id"), "left")
    status = (
        F.when(~is_object_id(F.col("requested_id")), F.lit(400))
        .when(F.col("known_id").isNull(), F.lit(404))
        .otherwise(F.lit(200))
    )
    return joined.select("requested_id", status.alias("status"), "title", "agent")


def append_status(incoming: DataFrame, heads: DataFrame) -> DataFrame:
    """FIL-14: body (422), then id syntax (400), then existence (404).

    A conversation with most of the messages is on the left of an outer join,
    where AQE can split it.
    """
    known = heads.select(F.col("id").alias("known_id"))
    rows = incoming.withColumn("lookup_id", F.lower("conversation_id"))
    joined = rows.join(known, F.col("lookup_id") == F.col("known_id"), "left")
    valid_role = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    status = (
        F.when(~valid_role, F.lit(422))
        .when(~is_object_id(F.col("conversation_id")), F.lit(400))
        .when(F.col("known_id").isNull(), F.lit(404))
        .otherwise(F.lit(201))
    )
    detail = (
        F.when(F.col("status") == 400, F.lit(INVALID_ID))
        .when(F.col("status") == 404, F.lit(NOT_FOUND))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("status", status).select(
        *incoming.columns, "status", detail.alias("detail")
    )


def accepted_messages(incoming: DataFrame, heads: DataFrame) -> DataFrame:
    """SNK-2: the rows to append, ids in lower case."""
    accepted = append_status(incoming, heads).where("status = 201")
    return accepted.withColumn(
        "conversation_id", F.lower("conversation_id")
    ).select(*incoming.columns)


def last_activity(messages: DataFrame) -> DataFrame:
    """The newest message time of each conversation."""
    return messages.groupBy("conversation_id").agg(
        F.max("created_at").alias("touched_at")
    )


def touch(heads: DataFrame, activity: DataFrame) -> DataFrame:
    """JON-3: moves ``updated_at`` forward to the newest accepted message."""
    joined = heads.join(activity, heads["id"] == activity["conversation_id"], "left")
    return joined.select(
        "id",
        "title",
        "agent",
        "created_at",
        F.greatest("updated_at", "touched_at").alias("updated_at"),
    )


def latest_value(changes: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """MAP-1: the last value written to each key; later columns of ``order`` break
    ties of the earlier ones."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def without_conversation(heads: DataFrame, conversation_id: str) -> DataFrame:
    """FIL-12: a list of conversations without one of them."""
    return heads.where(F.col("id") != conversation_id.lower())


def deletion_hits(requested: DataFrame, heads: DataFrame) -> DataFrame:
    """Ids to delete: requested, well-formed and present."""
    wanted = requested.where(is_object_id(F.col("requested_id")))
    ids = wanted.select(F.lower("requested_id").alias("id")).distinct()
    return ids.join(heads, "id", "left_semi")


def delete_cascade(
    requested: DataFrame, heads: DataFrame, messages: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """JON-2, FIL-12, MAP-2: the conversations and messages that remain.
    Messages go only with a conversation that existed."""
    hits = deletion_hits(requested, heads)
    gone = hits.select(F.col("id").alias("conversation_id"))
    return (
        heads.join(hits, "id", "left_anti"),
        messages.join(gone, "conversation_id", "left_anti"),
    )


def deletion_status(
    requested: DataFrame, heads: DataFrame, messages: DataFrame
) -> DataFrame:
    """AGG-3: 204, 400 or 404 per request, and how many messages went."""
    sizes = messages.groupBy(F.col("conversation_id").alias("sized_id")).agg(
        F.count(F.lit(1)).alias("size")
    )
    looked_up = lookup_status(requested, heads)
    joined = looked_up.join(
        sizes,
        (F.lower("requested_id") == F.col("sized_id")) & (F.col("status") == 200),
        "left",
    )
    status = F.when(F.col("status") == 200, F.lit(204)).otherwise(F.col("status"))
    return joined.select(
        "requested_id",
        status.alias("status"),
        F.coalesce("size", F.lit(0)).alias("deleted_messages"),
    )


def orphans(messages: DataFrame, heads: DataFrame) -> DataFrame:
    """JON-1: messages whose conversation does not exist."""
    known = heads.select(F.col("id").alias("conversation_id"))
    return messages.join(known, "conversation_id", "left_anti")


def agent_catalog(spark: SparkSession) -> DataFrame:
    """The two fixed agents; small enough to broadcast always."""
    schema = "agent string, agent_name string, agent_description string, icon string"
    return F.broadcast(spark.createDataFrame(AGENTS, schema))


def with_agent(rows: DataFrame) -> DataFrame:
    """JON-4, JON-5: agent default and catalog entry; an unknown agent has no
    entry and the default icon."""
    filled = rows.withColumn("agent", F.coalesce("agent", F.lit(DEFAULT_AGENT)))
    joined = filled.join(agent_catalog(rows.sparkSession), "agent", "left")
    return joined.withColumns(
        {
            "agent_name": F.coalesce("agent_name", F.lit("")),
            "agent_description": F.coalesce("agent_description", F.lit("")),
            "icon": F.coalesce("icon", F.lit(DEFAULT_ICON)),
        }
    )
