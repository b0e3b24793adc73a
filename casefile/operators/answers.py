"""Structured answers stored as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import first_filled
from casefile.schemas import ANSWER

# Severities that the client styles, its fallback, and the
# message of an error body without one.
SEVERITIES = ("info", "warning", "error")
DEFAULT_SEVERITY = "info"
UNKNOWN_ERROR = "An unexpected backend error occurred."

LISTS = {
    "story": "array<string>",
    "issues": "array<struct<severity:string,title:string,detail:string>>",
    "recommendations": "array<string>",
    "references": "array<struct<source:string,page:int>>",
}


def parse_answers(rows: DataFrame, body: str = "body") -> DataFrame:
    """JSN-3, PRJ-9: typed answer columns; absent lists become empty. The
    ``malformed`` column holds text that is not such an object."""
    schema = f"{ANSWER}, malformed string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    parsed = rows.withColumn("answer", F.from_json(body, schema, options))
    lists = {
        name: F.coalesce(f"answer.{name}", F.array().cast(kind))
        for name, kind in LISTS.items()
    }
    others = [c for c in rows.columns if c != body]
    return parsed.withColumns(
        {
            "summary": F.col("answer.summary"),
            **lists,
            "malformed": F.col("answer.malformed"),
        }
    ).select(*others, "summary", *LISTS, "malformed")


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good answers, and the quarantine."""
    return parsed.where("malformed IS NULL").drop("malformed"), parsed.where(
        "malformed IS NOT NULL"
    )


def validation(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """JSN-3, FIL-5: (key, faults, status) of each stored answer: 200, or 422 with the
    fields at fault. An answer needs a summary (it may be empty), every issue a title
    and one of the known severities, every reference a source. A body that is null or
    no such object has the fault ``body``."""
    parsed = parse_answers(rows.select(key, body, F.col(body).isNull().alias("no_body")), body)
    bad_body = F.col("malformed").isNotNull() | F.col("no_body")
    unknown = F.exists(
        "issues",
        lambda i: i["title"].isNull() | ~F.coalesce(i["severity"].isin(*SEVERITIES), F.lit(False)),
    )
    faults = F.array_compact(
        F.array(
            F.when(bad_body, F.lit("body")),
            F.when(~bad_body & F.col("summary").isNull(), F.lit("summary")),
            F.when(~bad_body & unknown, F.lit("issues")),
            F.when(~bad_body & F.exists("references", lambda r: r["source"].isNull()), F.lit("references")),
        )
    )
    checked = parsed.withColumn("faults", faults)
    return checked.select(
        key, "faults", F.when(F.size("faults") > 0, F.lit(422)).otherwise(F.lit(200)).alias("status")
    )


def shown_severity(severity: Column) -> Column:
    """CND-1."""
    return F.when(severity.isin(*SEVERITIES), severity).otherwise(
        F.lit(DEFAULT_SEVERITY)
    )


def page_label(page: Column) -> Column:
    """CND-2: no label without a page."""
    return F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string")))


def sections(parsed: DataFrame, key: str) -> DataFrame:
    """ARR-1, WIN-2, AGG-6: one row per displayed line, numbered from 1 within
    its section. An empty section yields no row. One pass, no shuffle."""

    def lines(name: str, text) -> Column:
        return F.transform(
            name,
            lambda x, i: F.struct(
                F.lit(name).alias("section"),
                (i + 1).cast("bigint").alias("step"),
                text(x).alias("line"),
            ),
        )

    def reference_text(ref: Column) -> Column:
        return F.concat_ws(" ", ref["source"], page_label(ref["page"]))

    summary = F.when(
        F.length("summary") > 0,
        F.array(
            F.struct(
                F.lit("summary").alias("section"),
                F.lit(1).cast("bigint").alias("step"),
                F.col("summary").alias("line"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<section:string,step:bigint,line:string>>"))
    shown = F.concat(
        summary,
        lines("story", lambda x: x),
        lines("issues", lambda x: x["title"]),
        lines("recommendations", lambda x: x),
        lines("references", reference_text),
    )
    # ``outer``, since a plain inline also filters on the array's size first.
    return parsed.select(key, F.inline_outer(shown)).where("section IS NOT NULL")


def issues(parsed: DataFrame, key: str) -> DataFrame:
    rows = parsed.select(key, F.posexplode("issues").alias("at", "issue"))
    return rows.select(
        key,
        (F.col("at") + 1).cast("bigint").alias("step"),
        shown_severity(F.col("issue.severity")).alias("severity"),
        F.col("issue.title").alias("title"),
        F.coalesce("issue.detail", F.lit("")).alias("detail"),
    )


def references(parsed: DataFrame, key: str) -> DataFrame:
    """ING-3."""
    rows = parsed.select(key, F.posexplode("references").alias("at", "ref"))
    return rows.select(
        key,
        (F.col("at") + 1).cast("bigint").alias("step"),
        F.col("ref.source").alias("source"),
        F.coalesce(page_label(F.col("ref.page")), F.lit("")).alias("page_label"),
    )


def variant_paths(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """JSN-1, JSN-2: values read out of an arbitrary object; null if malformed."""
    parsed = rows.select(key, F.try_parse_json(body).alias("value"))

    def at(path: str) -> Column:
        return F.try_variant_get("value", path, "string")

    return parsed.select(
        key,
        at("$.summary").alias("summary"),
        at("$.issues[0].severity").alias("severity"),
        at("$.references[0].source").alias("source"),
        at("$.references[0].page").alias("page"),
    )


def error_messages(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """CND-3, JSN-1."""
    error = F.from_json(body, "detail string, message string")
    parsed = rows.select(key, error.alias("error"))
    message = first_filled(
        F.col("error.detail"), F.col("error.message"), F.lit(UNKNOWN_ERROR)
    )
    return parsed.select(key, message.alias("message"))
