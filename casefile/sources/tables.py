"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder (SRC-1, SRC-2)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 200
) -> DataFrame:
    """The same table as a stream: of one file, or of the part files that appear
    in the folder of that name. The name is a glob, which both kinds match. A
    micro-batch has at most ``files_per_batch`` files."""
    reader: DataStreamReader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{name}[.]parquet")


def read_file_list(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-3, AGG-1: name, size and time of uploaded files. The content column
    is never selected, so no file is read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: one row per TXT or LOG file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.sha2(F.col("_metadata.file_path"), 256).substr(1, 24).alias("doc_id"),
        F.col("value").alias("text"),
        F.col("_metadata.file_name").alias("source"),
    )


def read_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: one row per line of the trace logs."""
    return spark.read.text(path).select(F.col("value").alias("line"))
