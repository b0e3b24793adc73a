"""Pairing of requests with reversals as traces arrive (STM-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casefile.functions.trace import REQUEST, REVERSAL

PAIR_SCHEMA = "rrn string, request_ts timestamp, reversal_ts timestamp"


def _lines(parsed: DataFrame, kind: str, time: str) -> DataFrame:
    rows = parsed.where((F.col("kind") == kind) & F.col("rrn").isNotNull())
    return rows.select("rrn", F.col("ts").alias(time))


def _follows(within: str) -> Column:
    end = F.col("request_ts") + F.expr(f"interval {within}")
    return (F.col("reversal_ts") >= F.col("request_ts")) & (F.col("reversal_ts") <= end)


def pair_reversals(
    requests: DataFrame, reversals: DataFrame, within: str, delay: str
) -> DataFrame:
    """Requests with the reversals that follow ``within`` an interval, joined as
    streams. Both sides have a watermark, so a request without a reversal is
    emitted, and forgotten, once its interval has closed."""
    left = _lines(requests, REQUEST, "request_ts").withWatermark("request_ts", delay)
    right = (
        _lines(reversals, REVERSAL, "reversal_ts")
        .withColumnRenamed("rrn", "reversed_rrn")
        .withWatermark("reversal_ts", delay)
    )
    same = F.col("rrn") == F.col("reversed_rrn")
    paired = left.join(right, same & _follows(within), "leftOuter")
    return paired.select("rrn", "request_ts", "reversal_ts")


def run_pairing(paired: DataFrame, folder: str) -> StreamingQuery:
    writer = paired.writeStream.format("parquet").outputMode("append")
    return (
        writer.option("path", f"{folder}/pairs")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def reconcile(
    spark: SparkSession, folder: str, parsed: DataFrame, within: str
) -> DataFrame:
    """Every request, with its reversal and how that was found.

    ``stream``: paired by the stream. A stream skips lines that come later than
    its delay, so the other requests are looked up in the stored lines: ``late``
    if they have a reversal after all, else ``none``.
    """
    pairs = spark.read.schema(PAIR_SCHEMA).parquet(f"{folder}/pairs")
    paired = pairs.where("reversal_ts IS NOT NULL")
    requests = _lines(parsed, REQUEST, "request_ts")
    rest = requests.join(paired, ["rrn", "request_ts"], "left_anti")
    reversals = _lines(parsed, REVERSAL, "reversal_ts")
    same = rest["rrn"] == reversals["rrn"]
    found = rest.join(reversals, same & _follows(within), "left").select(
        rest["rrn"], "request_ts", "reversal_ts"
    )
    late = F.when(F.col("reversal_ts").isNotNull(), F.lit("late"))
    return paired.withColumn("found", F.lit("stream")).unionByName(
        found.withColumn("found", late.otherwise(F.lit("none")))
    )
