"""Uploaded-file batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.files import (
    extension,
    fits_size_limit,
    size_text,
    upload_error,
)
from casefile.operators.chat import AGENTS
from casefile.operators.groups import PAGE_ROWS, gather_pages, with_page

# The reply to an accepted batch and the size-limit message.
RECEIVED = "Files received successfully"
TOO_LARGE = "The following files exceed 20 MB: "


def file_errors(uploads: DataFrame) -> DataFrame:
    """FIL-8, FIL-9, STR-3, STR-8: each file with its error or null."""
    name = F.col("filename")
    return uploads.withColumns(
        {"extension": extension(name), "error": upload_error(name)}
    )


def batch_status(uploads: DataFrame) -> DataFrame:
    """FIL-11: a batch fails with the message of its first bad file."""
    checked = file_errors(uploads).withColumn(
        "failure",
        F.when(F.col("error").isNotNull(), F.struct("ordinal", "error")),
    )
    batches = checked.groupBy("request_id", "agent").agg(
        F.min("failure").alias("failure"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("size").alias("total_size"),
    )
    failed = F.col("failure").isNotNull()
    return batches.select(
        "request_id",
        "agent",
        F.when(failed, F.lit(400)).otherwise(F.lit(200)).alias("status"),
        F.coalesce("failure.error", F.lit(RECEIVED)).alias("detail"),
        F.when(failed, F.lit(0)).otherwise(F.col("n_files")).alias("n_files"),
        F.when(failed, F.lit(0)).otherwise(F.col("total_size")).alias("total_size"),
    )


def request_status(uploads: DataFrame) -> DataFrame:
    """FIL-5, FIL-11: the reply to each batch; one for an unknown agent is refused
    before its files are looked at."""
    known = F.coalesce(F.col("agent").isin(*[a[0] for a in AGENTS]), F.lit(False))
    zero = F.lit(0)
    return batch_status(uploads).select(
        "request_id",
        "agent",
        F.when(known, F.col("status")).otherwise(F.lit(422)).alias("status"),
        F.when(known, F.col("detail")).otherwise(F.lit("agent")).alias("detail"),
        F.when(known, F.col("n_files")).otherwise(zero).alias("n_files"),
        F.when(known, F.col("total_size")).otherwise(zero).alias("total_size"),
    )


def accepted_files(uploads: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The files of batches without any bad file, with their page.

    A bad batch is listed once per page, so that the anti-join runs by (batch,
    page) and spreads a batch that holds most of the files.
    """
    bad = F.max(F.when(upload_error(F.col("filename")).isNotNull(), 1).otherwise(0))
    batches = uploads.groupBy("request_id").agg(
        bad.alias("bad"), F.coalesce(F.max("ordinal"), F.lit(0)).alias("last")
    )
    last_page = F.call_function("div", F.col("last"), F.lit(page_rows))
    failed = batches.where("bad = 1").select(
        "request_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last_page)).alias("page")
    )
    # A file without a place counts to the first page, so a bad batch takes it too.
    paged = with_page(uploads, "ordinal", page_rows).withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
    return paged.join(failed, ["request_id", "page"], "left_anti")


def manifest(accepted: DataFrame) -> DataFrame:
    """AGG-2, PRJ-3: the accepted files of each batch, in upload order."""
    item = F.struct("filename", "content_type", "size")
    keys = ["request_id", "agent"]
    return gather_pages(accepted, keys, "ordinal", item, "files").drop("first")


def attachment_lists(accepted: DataFrame, removed_position: Column) -> DataFrame:
    """PRJ-4, FIL-13: files as attachments, without the one that was removed."""
    item = F.struct(
        F.col("filename").alias("name"), "size", F.col("content_type").alias("type")
    )
    # Left out of the array and not of the rows: a batch whose only file is
    # removed keeps an empty list.
    removed = F.col("ordinal").eqNullSafe(removed_position)
    lists = gather_pages(accepted, ["request_id"], "ordinal", F.when(~removed, item), "attachments")
    return lists.drop("first").withColumn("attachments", F.array_compact("attachments"))


def without_position(items: Column, position: int | Column) -> Column:
    """FIL-13 on an array."""
    place = F.lit(position) if isinstance(position, int) else position
    return F.filter(items, lambda _, i: i != place)


def with_size_check(uploads: DataFrame) -> DataFrame:
    """FIL-10, SET-2, STR-5: each file with its size text and outcome."""
    outcome = F.when(fits_size_limit(F.col("size")), F.lit("accepted"))
    return uploads.withColumns(
        {
            "size_text": size_text(F.col("size")),
            "outcome": outcome.otherwise(F.lit("rejected")),
        }
    )


def split_by_size(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-2: accepted and rejected files; together they are the input."""
    fits = fits_size_limit(F.col("size"))
    return uploads.where(fits), uploads.where(~fits)


def size_messages(uploads: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """AGG-5: one message per batch with oversized files (one per page of them)."""
    _, rejected = split_by_size(uploads)
    name = F.coalesce("filename", F.lit(""))
    paged = with_page(rejected, "ordinal", page_rows)
    names = gather_pages(paged, ["request_id"], "ordinal", name, "names")
    message = F.concat(F.lit(TOO_LARGE), F.array_join("names", ", "))
    return names.select("request_id", "page", message.alias("message"))
