"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(number: Column) -> Column:
    """STR-6: a number as a 24-digit lower-case hex id."""
    return F.lpad(F.lower(F.hex(number)), 24, "0")


def is_object_id(value: Column) -> Column:
    """FIL-3: 24 hex digits. The length test rejects a trailing newline,
    which ``$`` alone lets through. Null counts as invalid."""
    valid = (F.length(value) == 24) & value.rlike("^[0-9a-fA-F]{24}$")
    return F.coalesce(valid, F.lit(False))


def stable_id(*parts: Column) -> Column:
    """STR-7: an id computed from the row, so that a retried task repeats it."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 24)


def message_id(conversation: Column, turn: Column) -> Column:
    """24 hex digits: 16 of the conversation's number, 8 of the turn."""
    parts = [F.lpad(F.lower(F.hex(c)), n, "0") for c, n in ((conversation, 16), (turn, 8))]
    return F.concat(*parts)
