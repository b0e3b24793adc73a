"""Writers. Plain parquet has no row update, so a change is a rewrite to a new
path that readers are then pointed at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casefile.session import work_dir


def append_rows(rows: DataFrame, path: str) -> None:
    """SNK-1, SNK-2: adds validated rows to a table."""
    rows.write.mode("append").parquet(path)


def write_version(rows: DataFrame, path: str) -> None:
    """SNK-3: writes a changed table to a path that must not exist yet."""
    rows.write.mode("errorifexists").parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """SNK-4: one JSON object per line."""
    report.write.json(path)


def write_text_report(report: DataFrame, path: str) -> None:
    """SNK-4: one JSON text per line, for plain-text readers."""
    columns = F.struct(*[F.col(c) for c in report.columns])
    report.select(F.to_json(columns).alias("value")).write.text(path)


# Keeps microseconds, which the default format of JSON cuts.
REPORT_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _report_marks(rows: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(format, bucket, n_rows, mark): rows of each bucket and a sum of their hashes."""
    mark = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), mark.alias("mark"))
    return counted.select(F.lit(kind).alias("format"), "bucket", "n_rows", "mark")


def read_report(spark: SparkSession, path: str, schema: StructType, kind: str) -> DataFrame:
    """An exported report, with its ``bucket``; ``kind`` is json or txt. A filter on
    the bucket opens only its folder."""
    fields = StructType([*schema.fields, StructField("bucket", LongType())])
    if kind == "json":
        return spark.read.schema(fields).options(**REPORT_OPTIONS).json(f"{path}/json")
    lines = spark.read.text(f"{path}/txt")
    # A report without rows has no folders, and so no column of them.
    bucket = F.col("bucket") if "bucket" in lines.columns else F.lit(None)
    row = F.from_json("value", schema, REPORT_OPTIONS).alias("row")
    return lines.select(row, bucket.cast("bigint").alias("bucket")).select("row.*", "bucket")


def export_report(report: DataFrame, path: str, key: str, buckets: int = 32) -> DataFrame:
    """SNK-4: ``report`` as JSON and TXT files in folders by a hash of ``key``, both read
    back and compared with what was to be written. The manifest (format, bucket, n_rows,
    mark) is written last and returned, so an export without one is not complete.

    ``key`` is unique or nearly so; rows of one key share a bucket. An export that
    differs from its rows raises an error and leaves no manifest.
    """
    spark = report.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    stored = materialized(report.select("*", bucket), "report")
    dealt = stored.repartition(buckets, "bucket")
    dealt.write.partitionBy("bucket").options(**REPORT_OPTIONS).json(f"{path}/json")
    line = F.to_json(F.struct(*report.columns), REPORT_OPTIONS).alias("value")
    dealt.select(line, "bucket").write.partitionBy("bucket").text(f"{path}/txt")
    found = [
        materialized(_report_marks(read_report(spark, path, report.schema, kind), report.columns, kind), f"marks-{kind}")
        for kind in ("json", "txt")
    ]
    for kind, marks in zip(("json", "txt"), found, strict=True):
        wanted = _report_marks(stored, report.columns, kind)
        if not wanted.exceptAll(marks).isEmpty() or not marks.exceptAll(wanted).isEmpty():
            raise RuntimeError(f"the {kind} files of the report differ from its rows")
    manifest = found[0].unionByName(found[1])
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the session's shared folder and read again, for results
    that later steps read several times: a lost executor costs none of them."""
    spark = df.sparkSession
    folder = work_dir(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
