"""Boundaries of the scalar rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casefile.functions import files, ids, text
from casefile.operators.answers import page_label, shown_severity
from casefile.operators.trace import agent_summary


def evaluate(spark, make, values, kind="string"):
    """``make`` applied to each value, in one query."""
    rows = spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], f"i int, v {kind}"
    )
    found = rows.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()
    return [row.r for row in found]


def test_object_id(spark):
    good = "0123456789abcdefABCDEF01"
    values = [good, good[:-1], good + "0", good[:-1] + "g", good + "\n", "", None]
    found = evaluate(spark, ids.is_object_id, values)
    assert found == [True, False, False, False, False, False, False]


def test_hex_id(spark):
    assert evaluate(spark, ids.hex_id, [31], "bigint") == ["0" * 22 + "1f"]


def test_stable_id_repeats(spark):
    first = evaluate(spark, lambda c: ids.stable_id(c), ["a", "b", None])
    assert first == evaluate(spark, lambda c: ids.stable_id(c), ["a", "b", None])
    assert len(set(first)) == 3
    assert all(len(x) == 24 for x in first)


def test_trim(spark):
    values = ["  a b ", " a　", "﻿a\n", "a\u0085", " a \u0085", " \t\n", ""]
    expected = ["a b", "a", "a", "a\u0085", "a \u0085", "", ""]
    assert evaluate(spark, text.js_trim, values) == expected
    blank = evaluate(spark, text.is_not_blank, [*values, None])
    assert blank == [bool(e) for e in expected] + [False]


def test_title(spark):
    found = evaluate(spark, text.auto_title, ["x" * 40, "x" * 41, ""])
    assert found == ["x" * 40, "x" * 40 + "…", ""]


def test_tokens(spark):
    found = evaluate(spark, text.tokens, ["Été 12-ab, É", "--"])
    assert found == [["été", "12", "ab", "é"], []]
    assert evaluate(spark, text.first_token, ["-- Ab c", "--"]) == ["ab", None]


@pytest.mark.parametrize(
    ("question", "intent"),
    [
        ("What does response code 05 mean?", "response_code"),
        ("Explain FLD 039", "message_field"),
        ("Which HSM is used?", "hsm_command"),
        ("How do I reverse it?", "procedure"),
        ("Give an example.", "example"),
        ("and for 0400?", "follow_up"),
        ("andré", "concept"),
        ("  What is an issuer?", "concept"),
    ],
)
def test_intent(spark, question, intent):
    assert evaluate(spark, text.question_intent, [question]) == [intent]


def test_first_filled(spark):
    rows = spark.createDataFrame(
        [("d", "m"), ("", "m"), (None, ""), (None, None)], "a string, b string"
    )
    chosen = text.first_filled(F.col("a"), F.col("b"), F.lit("z"))
    assert [r[0] for r in rows.select(chosen).collect()] == ["d", "m", "z", "z"]


def test_extension(spark):
    values = ["a.PDF", "x.", ".pdf", "a.b.Txt"]
    assert evaluate(spark, files.extension, values) == [".pdf", ".", ".pdf", ".txt"]


def test_upload_error(spark):
    values = ["a.pdf", ".LOG", None, "", "noext", "a.exe", "x."]
    assert evaluate(spark, files.upload_error, values) == [
        None,
        None,
        "A file does not have a valid filename.",
        "A file does not have a valid filename.",
        "File extension missing for noext.",
        "Unsupported file type: .exe",
        "Unsupported file type: .",
    ]


def test_size_text(spark):
    sizes = [0, 1023, 1024, 1280, 1048575, 1048576, 20 * 1024 * 1024 + 1, None]
    assert evaluate(spark, files.size_text, sizes, "bigint") == [
        "0 B",
        "1023 B",
        "1.0 KB",
        "1.3 KB",
        "1024.0 KB",
        "1.00 MB",
        "20.00 MB",
        None,
    ]


def test_size_limit(spark):
    limit = 20 * 1024 * 1024
    found = evaluate(
        spark, files.fits_size_limit, [limit - 1, limit, limit + 1], "bigint"
    )
    assert found == [True, True, False]


def test_severity_and_page(spark):
    shown = evaluate(spark, shown_severity, ["error", "critical", None])
    assert shown == ["error", "info", "info"]
    assert evaluate(spark, page_label, [7, None], "int") == ["p.7", None]


def test_agent_summary(spark):
    found = evaluate(spark, lambda c: agent_summary(c, F.lit("q")), ["log", "other"])
    assert found[0] == "Analyzed the provided trace."
    assert found[1].endswith('answer: "q".')
