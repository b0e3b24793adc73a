"""Text expressions. Lengths count code points, where a browser counts UTF-16
units; both agree on text without astral characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a browser's trim() removes.
JS_SPACE = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)
TITLE_LENGTH = 40
TOKEN = r"[\p{L}\p{N}]+"

# Word limits are spelled out, since engines disagree on \b next to accents.
_START = r"(?:^|[^\p{L}\p{N}])"
_END = r"(?:[^\p{L}\p{N}]|$)"
# Ordered: the first rule that matches names the intent.
INTENT_RULES = tuple(
    (name, start + words + _END)
    for name, start, words in (
        ("follow_up", "^", "(?:and|what about|why|same for)"),
        ("response_code", _START, "(?:response|reject) +codes?"),
        ("message_field", _START, "(?:mti|iso ?8583|fld|de-?[0-9]+|fields? +[0-9]+)"),
        ("hsm_command", _START, "hsm"),
        ("procedure", _START, "(?:how|steps?|procedures?)"),
        ("example", _START, "examples?"),
    )
)
DEFAULT_INTENT = "concept"


def js_trim(text: Column) -> Column:
    """STR-1. ``\\z``, because ``$`` also matches before a last line break."""
    return F.regexp_replace(text, rf"\A{JS_SPACE}+|{JS_SPACE}+\z", "")


def is_not_blank(text: Column) -> Column:
    """FIL-7: whether anything but white space is there."""
    return F.coalesce(text.rlike(f"[^{JS_SPACE[1:]}"), F.lit(False))


def auto_title(text: Column) -> Column:
    """STR-2: text beyond 40 characters is cut and marked with an ellipsis."""
    return F.when(
        F.length(text) > TITLE_LENGTH,
        F.concat(F.substring(text, 1, TITLE_LENGTH), F.lit("…")),
    ).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def first_token(text: Column) -> Column:
    """The first of them, or null."""
    found = F.regexp_extract(F.lower(text), TOKEN, 0)
    return F.nullif(found, F.lit(""))


def question_intent(question: Column) -> Column:
    """RET-4: README-only in the reference; the rules are ours."""
    text = F.lower(js_trim(question))
    intent = F.lit(None).cast("string")
    for name, pattern in INTENT_RULES:
        intent = F.coalesce(intent, F.when(text.rlike(pattern), F.lit(name)))
    return F.coalesce(intent, F.lit(DEFAULT_INTENT))


def first_filled(*choices: Column) -> Column:
    """CND-3: the first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def time_text(time: Column) -> Column:
    """A timestamp to the microsecond, in the session's zone."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")
