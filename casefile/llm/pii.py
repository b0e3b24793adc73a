"""Personal data in texts, with built-in SQL functions only.

Patterns propose spans, validators confirm them (ranges, digit counts, Luhn,
mod-97), and words near a span raise its score. Spans of the base kinds stay
whatever their score is; the added kinds (iban, secret) need the threshold.

The patterns never give characters back, so a long run of letters or digits is
read once. Two functions give the places: ``regexp_extract_all`` has the matches
and ``split`` the text between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # A match begins where a run of its first characters begins, or where the
    # preceding match ended.
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9+/_-]{24,}+",
}
# Before the patterns are tried, a text must hold what every match holds.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9]{4}|[0-9][\x20-][0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "secret": r"[A-Za-z0-9+/_-]{24}",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "secret"]
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|debit|pay",
    "phone": r"phone|\btel\b|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "secret": r"token|secret|passw|api|credential|\bkey\b",
}
NEAR_CHARS = 40
BLOCK = 4096
PART = 256
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "secret": 0.3}
CONTEXT_SCORE = 0.3
SPAN = "struct<kind:string,rank:int,start:int,end:int,score:double>"


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    size = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        value = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (size - i) % 2)
        return total + value - F.when(value > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a code of letters and digits has the remainder 1 of its kind."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        point = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(point < 65, rest * 10 + point - 48).otherwise(rest * 100 + point - 55) % 97

    size = F.length(plain)
    fits = size.between(15, 34)
    return fits & (F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), step) == 1)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        byte = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^(?:0*[0-9]|{byte})(?:\.(?:0*[0-9]|{byte})){{3}}$")
    if kind == "card":
        # The sum is taken of card-sized numbers only, so a long run costs nothing.
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _blocks(text: Column) -> Column:
    """``text`` in blocks of BLOCK characters, so that a place in a long text is
    reached without counting from its beginning."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.octet_length(text) <= BLOCK, F.array(text)).otherwise(cut)


def _piece(blocks: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` on, counted from 0."""
    first = F.call_function("div", start, F.lit(BLOCK)).cast("int")
    number = F.call_function("div", start % BLOCK + size, F.lit(BLOCK)).cast("int") + 1
    return F.substring(F.array_join(F.slice(blocks, first + 1, number), ""), start % BLOCK + 1, size)


def _items(text: Column, kind: str) -> Column:
    """The matches of a kind with the length of the text before each, in parts of
    PART; the text after the last match is an item without a value."""
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    items = F.zip_with(values, between, lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("gap")))
    return F.when(text.rlike(HINTS[kind]), items).otherwise(nothing)


def _parts(items: Column) -> Column:
    """Items without a match, as most texts have them, stay one part."""
    last = F.call_function("div", F.size(items) - 1, F.lit(PART)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * PART + 1, PART))
    return F.when(F.size(items) <= PART, F.array(items)).otherwise(cut)


def _part_length(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda at, i: at + i["gap"] + F.coalesce(F.length(i["value"]), F.lit(0)))


def _spans_of_part(blocks: Column, part: Column, begin: Column, kind: str) -> Column:
    """The validated spans of one part of the items, which starts at ``begin``."""
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        end = start + F.coalesce(F.length(item["value"]), F.lit(0))
        left = F.greatest(start - NEAR_CHARS, F.lit(0))
        near = F.concat(_piece(blocks, left, start - left), F.lit(" "), _piece(blocks, end, F.lit(NEAR_CHARS)))
        score = F.lit(START_SCORE[kind]) + F.when(
            F.lower(near).rlike(CONTEXT[kind]), F.lit(CONTEXT_SCORE)
        ).otherwise(F.lit(0.0))
        span = F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"),
            start.alias("start"), end.alias("end"), score.alias("score"),
        ).cast(SPAN)
        valid = item["value"].isNotNull() & F.coalesce(_valid(kind, item["value"]), F.lit(False))
        spans = F.when(valid, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    state = F.struct(begin.alias("at"), empty.alias("spans"))
    return F.aggregate(part, state, step, lambda s: s["spans"])


def with_spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``pii``: the spans (kind, rank of the kind, start, end, score) by kind
    and start; code points, end exclusive. Added kinds need a score of ``least``.

    Per kind, spans are the leftmost non-overlapping matches; one that fails its
    validator is dropped and not tried again. Whole texts; null ones have no
    spans. Every row is kept, repeats too; a column named ``pii`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # A fold copies what it carries at every step, so it only ever carries a part of
    # the spans; the parts' lengths give their places. Each step is a column of its
    # own, because a lambda evaluates the expressions that it names anew each time.
    kinds = {k: f"__{k}" for k in KINDS}
    cut = docs.drop("pii").withColumn("__blocks", _blocks(text))
    cut = cut.withColumns({c: _items(text, k) for k, c in kinds.items()})
    cut = cut.withColumns({c: _parts(F.col(c)) for c in kinds.values()})
    cut = cut.withColumns({f"{c}_sizes": F.transform(c, _part_length) for c in kinds.values()})

    def spans_of(kind: str) -> Column:
        sizes = F.col(f"{kinds[kind]}_sizes")

        def part_spans(part: Column, k: Column) -> Column:
            begin = F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda at, size: at + size)
            return _spans_of_part(F.col("__blocks"), part, begin, kind)

        return F.flatten(F.transform(kinds[kind], part_spans))

    found = cut.withColumns({c: spans_of(k) for k, c in kinds.items()})
    found = found.drop("__blocks", *(f"{c}_sizes" for c in kinds.values()))
    # Each kind is computed once and only then put together.
    added = F.filter(F.concat(*(F.col(f"__{k}") for k in KINDS if k not in BASE)), lambda s: s["score"] >= least)
    spans = F.concat(*(F.col(f"__{k}") for k in BASE), added)
    return found.withColumn("pii", spans).drop(*(f"__{k}" for k in KINDS))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping
    spans the one that begins first counts, then the longer one, and the others'
    remainder goes with it. A text without spans is unchanged; null stays null."""
    order = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["rank"].alias("rank"), s["kind"].alias("kind")
            ),
        )
    )

    def step(state: Column, span: Column) -> Column:
        end = -span["minus_end"]
        fresh = span["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        mark = F.concat(before, F.lit("["), F.upper(span["kind"]), F.lit("]"))
        parts = F.when(fresh, F.array_append(state["parts"], mark)).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], end).alias("at"), parts.alias("parts"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = F.length(text)
    whole = F.aggregate(
        order,
        begin,
        step,
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, rest)),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts by base kind and digests of the spans, one row per document."""
    rows = with_spans(docs.select("doc_id", "text"), least).select("doc_id", "pii")

    def of(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id",
        *(of(k) for k in BASE),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("pii")).alias("spans"),
        *(of(k) for k in KINDS if k not in BASE),
    )
