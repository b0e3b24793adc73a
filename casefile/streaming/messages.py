"""Message append as a stream (STM-1, STM-2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructType

from casefile.operators.chat import accepted_messages, append_status, last_activity, touch


def _stored_before(batch: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """Ids of the messages of earlier batches. A message may be sent again at any
    later time and with a new time stamp, so only its id counts; of the stored files
    no other column is read."""
    spark = batch.sparkSession
    schema = "id string, batch_id bigint"
    if not batch_id:
        return spark.createDataFrame([], schema).select("id")
    stored = spark.read.schema(schema).option("basePath", f"{folder}/messages")
    return stored.parquet(f"{folder}/messages/batch_id=*").where(F.col("batch_id") < batch_id).select("id")


def append_messages(
    incoming: DataFrame, heads: DataFrame | Callable[[], DataFrame], folder: str
) -> StreamingQuery:
    """STM-1, STM-2: validates incoming messages, appends the accepted ones that
    are not stored yet, and records which conversations they touch and which
    messages were rejected.

    A message is dropped only if its id is stored already, however late it comes.
    A function as ``heads`` is called for every batch, so conversations that were
    created meanwhile count. A micro-batch writes only its own ``batch_id``
    folders and overwrites them, so that a repeated batch changes nothing.
    Touches are a small log next to the messages; the conversation table is not
    rewritten per batch.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        known = heads() if callable(heads) else heads
        judged = append_status(batch, known)
        rejected = judged.where("status <> 201")
        rejected.write.mode("overwrite").parquet(f"{folder}/rejects/batch_id={batch_id}")
        accepted = accepted_messages(batch, known)
        fresh = accepted.dropDuplicates(["id"]).join(_stored_before(batch, folder, batch_id), "id", "left_anti")
        target = f"{folder}/messages/batch_id={batch_id}"
        fresh.select(accepted.columns).write.mode("overwrite").parquet(target)
        stored = batch.sparkSession.read.schema(accepted.schema).parquet(target)
        log = f"{folder}/touches/batch_id={batch_id}"
        last_activity(stored).write.mode("overwrite").parquet(log)

    writer = incoming.writeStream.foreachBatch(store).trigger(availableNow=True)
    return writer.option("checkpointLocation", f"{folder}/progress").start()


def read_rejected(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rejected messages with their status and detail."""
    judged = StructType(list(schema.fields)).add("status", IntegerType()).add("detail", StringType())
    return spark.read.schema(judged).parquet(f"{folder}/rejects/batch_id=*")


def read_appended(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All messages that the stream has appended."""
    return spark.read.schema(schema).parquet(f"{folder}/messages/batch_id=*")


def read_touched(spark: SparkSession, folder: str, heads: DataFrame) -> DataFrame:
    """The conversations with the touches of the stream applied."""
    schema = "conversation_id string, touched_at timestamp"
    touches = spark.read.schema(schema).parquet(f"{folder}/touches/batch_id=*")
    newest = touches.withColumnRenamed("touched_at", "created_at")
    return touch(heads, last_activity(newest))
