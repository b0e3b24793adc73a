"""Document levels: sections, content units, facts, function catalog, memory.

Arrays are exploded with the ``outer`` forms: the plain ones make Spark infer a
filter on the array's size, which computes the array twice.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import (
    first_token,
    is_not_blank,
    js_trim,
    question_intent,
)
from casefile.operators.groups import HOT_ROWS, number_rows, with_preceding

MEMORY_TURNS = 3

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^ \t\r\n<>\"]+"
# kind, pattern, and what every match contains: text without it is not searched.
FACTS = (("number", NUMBER, ""), ("email", EMAIL, "@"), ("url", URL, "http"))

# What a reader of a page does not see.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)
ATTRIBUTES = r"(?:[\s/][^>]*)?>"
HEADING = "(?i)<h[1-6]" + ATTRIBUTES
PARAGRAPH = "(?i)<p" + ATTRIBUTES
ITEM = "(?i)<li" + ATTRIBUTES
BLOCK = "(?i)(?=<(?:title|h[1-6]|p|li)" + ATTRIBUTES + ")"
BLOCK_KIND = r"(?i)\A<(title|h|p|li)[1-6]?" + ATTRIBUTES
# Closing tags may be missing: a block also ends where its list or article does;
# that the next block ends it follows from the split on opening tags.
UNTIL_END = r"(.*?)(?=</?(?:title|h[1-6]|p|li|ul|ol|nav|article)(?:[\s/][^>]*)?>|\z)"
BLOCK_TEXT = r"(?is)\A<[^>]*>" + UNTIL_END
TAG = r"(?s)<[^>]*>"
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
LANGUAGE = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z0-9-]+)"
PART_NAMES = {"title": "title", "h": "heading", "p": "paragraph", "li": "item"}


def _entity(entity: Column) -> Column:
    """The character that an entity stands for; unknown names stay as they are, and
    numbers that are no character become U+FFFD."""
    names = F.map_from_arrays(
        F.array(*(F.lit(f"&{name};") for name in name2codepoint)),
        F.array(*(F.lit(chr(code)) for code in name2codepoint.values())),
    )
    digits = F.regexp_extract(entity, "[0-9a-fA-F]+", 0)
    number = F.when(F.lower(F.substring(entity, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
    code = number.try_cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    numeric = F.when(valid, char).otherwise(F.lit("\ufffd"))
    return F.when(F.startswith(entity, F.lit("&#")), numeric).otherwise(F.coalesce(F.try_element_at(names, entity), entity))


def plain_text(html: Column) -> Column:
    """HTML without tags, entities decoded once, trimmed. Text and entities are cut
    apart and joined again, so ``&amp;lt;`` becomes ``&lt;`` and the time is linear."""
    bare = F.regexp_replace(html, TAG, " ")
    entities = F.transform(F.regexp_extract_all(bare, F.lit(ENTITY), F.lit(0)), _entity)
    between = F.split(bare, ENTITY, -1)
    joined = F.zip_with(between, entities, lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return js_trim(F.when(F.contains(bare, F.lit("&")), F.array_join(joined, "")).otherwise(bare))


def _filled(units: DataFrame) -> DataFrame:
    return units.where(is_not_blank(F.col("unit")))


def text_units(documents: DataFrame) -> DataFrame:
    """ING-1, ING-3: the non-blank lines of a document, with their line number."""
    lines = documents.select(
        "doc_id", "source", F.posexplode_outer(F.split("text", "\n")).alias("at", "unit")
    )
    return _filled(
        lines.select(
            "doc_id", "source", (F.col("at") + 1).cast("bigint").alias("unit_no"), "unit"
        )
    )


def page_units(pages: DataFrame) -> DataFrame:
    """ING-1 over HTML: the title, headings, paragraphs and list items, closed or
    not, in order, with their ``part`` and the page's language ('' if not given).

    Comments, scripts and styles hold no blocks; tags are removed and entities
    decoded. A block lasts from its opening tag to the next block, to the end of a
    block, list or article, or to the end of the page. Blank blocks are numbered
    but left out; a page without HTML has none.
    """
    visible = F.regexp_replace("html", HIDDEN, " ")

    def is_block(part: Column) -> Column:
        return part.rlike(BLOCK_KIND)

    lines = pages.select(
        F.col("page_id").alias("doc_id"),
        F.col("url").alias("source"),
        F.lower(F.regexp_extract("html", LANGUAGE, 1)).alias("lang"),
        # What comes before the first block is a part of its own, or none.
        F.posexplode_outer(F.filter(F.split(visible, BLOCK), is_block)).alias("at", "block"),
    )
    kind = F.lower(F.regexp_extract("block", BLOCK_KIND, 1))
    named = F.lit(None).cast("string")
    for tag, part in PART_NAMES.items():
        named = F.when(kind == tag, F.lit(part)).otherwise(named)
    return _filled(
        lines.withColumn("part", named)
        .where("part IS NOT NULL")
        .select(
            "doc_id",
            "source",
            "lang",
            "part",
            (F.col("at") + 1).cast("bigint").alias("unit_no"),
            plain_text(F.regexp_extract("block", BLOCK_TEXT, 1)).alias("unit"),
        )
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """ING-1: the text between one heading and the next; section 0 comes before
    the first heading. Paragraphs and list items count by their opening tags."""
    visible = F.regexp_replace("html", HIDDEN, " ")
    parts = pages.select(
        F.col("page_id").alias("doc_id"),
        F.col("url").alias("source"),
        F.posexplode_outer(F.split(visible, HEADING)).alias("section_no", "part"),
    ).where("part IS NOT NULL")
    titled = F.col("section_no") > 0
    heading = F.regexp_extract("part", r"(?is)\A" + UNTIL_END, 1)
    title = F.when(titled, heading).otherwise(F.lit(""))

    def opened(tag: str) -> Column:
        return (F.size(F.split("part", tag)) - 1).cast("bigint")

    return parts.select(
        "doc_id",
        "source",
        F.col("section_no").cast("bigint").alias("section_no"),
        plain_text(title).alias("title"),
        opened(PARAGRAPH).alias("n_paragraphs"),
        opened(ITEM).alias("n_items"),
    )


def facts(documents: DataFrame) -> DataFrame:
    """ING-2: numbers, e-mail addresses and links, in order of appearance."""

    def found(kind: str, pattern: str, mark: str) -> Column:
        searched = F.when(F.contains("text", F.lit(mark)), F.col("text"))
        matches = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
        return F.transform(
            F.coalesce(matches, F.array().cast("array<string>")),
            lambda value, i: F.struct(
                F.lit(kind).alias("kind"),
                (i + 1).cast("bigint").alias("fact_no"),
                value.alias("value"),
            ),
        )

    all_found = F.concat(*[found(*fact) for fact in FACTS])
    rows = documents.select("doc_id", "source", F.inline_outer(all_found))
    return rows.where("kind IS NOT NULL")


def function_catalog(units: DataFrame) -> DataFrame:
    """AGG-10: per function key, how often and where. A key is the first token
    of a unit. Documents are counted in two steps, by (key, document) first, so
    a key with most of the units is spread over many tasks."""
    keyed = units.select(
        "doc_id", "unit_no", first_token(F.col("unit")).alias("key")
    ).where("key IS NOT NULL")
    per_document = keyed.groupBy("key", "doc_id").agg(
        F.count(F.lit(1)).alias("units"), F.min("unit_no").alias("unit_no")
    )
    catalog = per_document.groupBy("key").agg(
        F.sum("units").alias("n_units"),
        F.count(F.lit(1)).alias("n_documents"),
        F.min(F.struct("doc_id", "unit_no")).alias("first"),
    )
    return catalog.select(
        "key",
        "n_units",
        "n_documents",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.unit_no").alias("first_unit_no"),
    )


def memory(
    messages: DataFrame, turns: int = MEMORY_TURNS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """WIN-3: each message with the turns before it as context text."""
    item = F.concat_ws(": ", "role", "content")
    remembered = with_preceding(
        messages, "conversation_id", "created_at", ["id"], item, turns, "previous",
        hot_rows,
    )
    return remembered.select(
        "conversation_id",
        "id",
        "created_at",
        F.size("previous").cast("bigint").alias("n_previous"),
        F.array_join("previous", "\n").alias("context"),
    )


def memory_state(
    messages: DataFrame, turns: int = MEMORY_TURNS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """WIN-4: the newest turns of each conversation as one context text."""
    newest = number_rows(
        messages, "conversation_id", "created_at", ["id"], "age", hot_rows,
        newest=True, limit=turns,
    )
    entry = F.struct(
        (-F.col("age")).alias("at"), F.concat_ws(": ", "role", "content").alias("text")
    )
    # At most ``turns`` entries per conversation.
    states = newest.groupBy("conversation_id").agg(
        F.max("created_at").alias("updated_at"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    return states.select(
        "conversation_id",
        "updated_at",
        F.array_join(F.transform("entries", lambda e: e["text"]), "\n").alias("context"),
    )


def resolved_questions(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """RET-4: each non-blank user message, a follow-up with the user message before
    it in its conversation, on a line of its own; ``resolved`` stands alone."""
    asked = messages.where((F.col("role") == "user") & is_not_blank(F.col("content"))).select(
        "id",
        "conversation_id",
        "created_at",
        js_trim(F.col("content")).alias("question"),
        question_intent(F.col("content")).alias("intent"),
    )
    known = with_preceding(
        asked, "conversation_id", "created_at", ["id"], F.col("question"), 1, "previous", hot_rows
    )
    depends = (F.col("intent") == "follow_up") & (F.size("previous") > 0)
    resolved = F.when(depends, F.concat_ws("\n", F.get("previous", 0), "question"))
    return known.select(
        "id", "conversation_id", "intent", F.coalesce(resolved, "question").alias("resolved")
    )


def question_intents(messages: DataFrame) -> DataFrame:
    """RET-4, FIL-7, STR-1: the intent of each non-blank user message."""
    questions = messages.where((F.col("role") == "user") & is_not_blank(F.col("content")))
    return questions.select(
        "id",
        "conversation_id",
        js_trim(F.col("content")).alias("question"),
        question_intent(F.col("content")).alias("intent"),
    )
