"""Streams against their batch results."""

from __future__ import annotations

import os
import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from casefile.operators import chat, trace
from casefile.schemas import CONVERSATION_TURN, EVENT
from casefile.session import work_dir
from casefile.sources import views
from casefile.sources.tables import read_table, stream_table
from casefile.streaming import messages, pairing

FOLDER = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def many_files(spark, table, target, order, files=4):
    """The table in several files, in order of ``order``."""
    rows = read_table(spark, FOLDER, table)
    ordered = rows.repartitionByRange(files, order).sortWithinPartitions(order)
    ordered.write.parquet(target)


def stream(spark, schema, source):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(source)


@pytest.fixture
def turns(spark):
    return read_table(spark, FOLDER, "conversations")


def test_append_in_batches_and_replay(spark, turns, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    many_files(spark, "conversations", source, "conv_id")
    heads = views.conv_heads(turns)

    def run():
        incoming = views.incoming_messages(stream(spark, CONVERSATION_TURN, source))
        query = messages.append_messages(incoming, heads, target)
        query.awaitTermination()

    run()
    expected = chat.accepted_messages(views.incoming_messages(turns), heads)
    appended = messages.read_appended(spark, target, expected.schema)
    columns = ["id", "conversation_id", "role", "content", "created_at"]
    assert rows_of(appended, *columns) == rows_of(expected, *columns)
    touched = messages.read_touched(spark, target, heads)
    batch = chat.touch(heads, chat.last_activity(expected))
    assert rows_of(touched, "id", "updated_at") == rows_of(batch, "id", "updated_at")

    # Losing the progress replays every batch; the tables stay as they are.
    shutil.rmtree(f"{target}/progress")
    run()
    again = messages.read_appended(spark, target, expected.schema)
    assert rows_of(again, *columns) == rows_of(expected, *columns)


def test_resends_are_dropped_across_batches(spark, turns, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for name in ("a", "b"):
        many_files(spark, "conversations", f"{source}/{name}", "conv_id", files=1)
    reader = spark.readStream.schema(CONVERSATION_TURN)
    reader = reader.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    incoming = views.incoming_messages(reader.parquet(source))
    heads = views.conv_heads(turns)
    messages.append_messages(incoming, heads, target).awaitTermination()
    expected = chat.accepted_messages(views.incoming_messages(turns), heads)
    appended = messages.read_appended(spark, target, expected.schema)
    assert rows_of(appended, "id") == rows_of(expected, "id")


def test_resend_at_a_new_time_is_stored_once(spark, turns, tmp_path):
    """The same ids come again in later batches, each time an hour later."""
    heads = views.conv_heads(turns)
    sent = views.incoming_messages(turns)
    expected = chat.accepted_messages(sent, heads)
    for hour in range(3):
        late = sent.withColumn("created_at", F.col("created_at") + F.expr(f"interval {hour} hours"))
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    incoming = stream(spark, sent.schema, str(tmp_path / "in"))
    messages.append_messages(incoming, heads, target).awaitTermination()
    appended = messages.read_appended(spark, target, expected.schema)
    assert rows_of(appended, "id") == rows_of(expected, "id")


@pytest.mark.parametrize("in_order", [True, False])
def test_pairing_in_batches(spark, tmp_path, in_order):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    many_files(spark, "events", source, "event_id")
    files = sorted(pathlib.Path(source).glob("*.parquet"), reverse=not in_order)
    for place, file in enumerate(files):
        os.utime(file, (1_700_000_000 + place, 1_700_000_000 + place))

    def parsed():
        return trace.parse_trace(views.trace_lines(stream(spark, EVENT, source)))

    paired = pairing.pair_reversals(parsed(), parsed(), "10 seconds", "1 hour")
    pairing.run_pairing(paired, target).awaitTermination()
    batch = trace.parse_trace(views.trace_lines(read_table(spark, FOLDER, "events")))
    rows = pairing.reconcile(spark, target, batch, "10 seconds")
    cards = trace.transactions(batch)
    columns = ["rrn", "request_ts", "reversal_ts"]
    assert rows_of(rows, *columns) == rows_of(cards, *columns)
    ways = {r.found for r in rows.select("found").distinct().collect()}
    assert ways == ({"stream", "none"} if in_order else {"stream", "late", "none"})
    # The stream itself closes requests without a reversal, up to the watermark.
    closed = spark.read.parquet(f"{target}/pairs").where("reversal_ts IS NULL")
    assert closed.count() > 0


def test_late_first_messages_and_rejects_are_kept(spark, turns, tmp_path):
    """Batches a day apart, the newest first: nothing is too late to be stored."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    top = turns.agg({"conv_id": "max"}).first()[0]
    for place, low in enumerate((2 * top // 3, top // 3, -1)):
        high = (top, 2 * top // 3, top // 3)[place]
        part = turns.where(f"conv_id > {low} AND conv_id <= {high}").coalesce(1)
        part.write.mode("append").parquet(f"{source}/conversations.parquet")
        for file in pathlib.Path(f"{source}/conversations.parquet").glob("*.parquet"):
            if file.stat().st_mtime > 1_800_000_000 or place == 0:
                os.utime(file, (1_700_000_000 + place, 1_700_000_000 + place))
    incoming = views.incoming_messages(stream_table(spark, source, "conversations", CONVERSATION_TURN, 1))
    start = F.unix_micros(F.lit(views.EPOCH).cast("timestamp"))
    apart = F.timestamp_micros(start + (F.unix_micros("created_at") - start) * 1440)
    spread_out = incoming.withColumn("created_at", apart)
    heads = views.conv_heads(turns)
    messages.append_messages(spread_out, lambda: heads, target).awaitTermination()
    batch = chat.append_status(views.incoming_messages(turns), heads)
    appended = messages.read_appended(spark, target, chat.accepted_messages(views.incoming_messages(turns), heads).schema)
    assert rows_of(appended, "id") == rows_of(batch.where("status = 201"), "id")
    rejected = messages.read_rejected(spark, target, views.incoming_messages(turns).schema)
    assert rows_of(rejected, "id", "status") == rows_of(batch.where("status <> 201"), "id", "status")
    assert appended.count() + rejected.count() == turns.count()


def test_streams_read_part_files(spark, turns, tmp_path):
    turns.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    for folder in (str(tmp_path), FOLDER):
        rows = stream_table(spark, folder, "conversations", CONVERSATION_TURN)
        query = rows.writeStream.format("memory").queryName("parts").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("parts").count() == turns.count()


def test_work_dir_follows_the_session(spark, shared_folder):
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first.startswith(f"{shared_folder}/x-") and first != second
