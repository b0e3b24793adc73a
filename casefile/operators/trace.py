"""Transaction traces. README-only in the reference: field names, statuses and
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.trace import (
    COMMAND,
    REPLY,
    REQUEST,
    RESPONSE,
    REVERSAL,
    field,
    function_name,
    kind_rank,
    line_kind,
    line_time,
    masked_card,
    millis_between,
    sentence,
    value_after,
)
from casefile.operators.groups import (
    HOT_ROWS,
    PAGE_ROWS,
    gather_pages,
    number_rows,
    with_page,
)

APPROVED = "00"
LATENCY_LIMIT_MS = 3000

# rule, severity, title, recommendation. The first two titles are fixed values.
RULES = (
    (
        "R1",
        "error",
        "Missing DE-39 in reversal message",
        "Copy the response code into the reversal.",
    ),
    (
        "R2",
        "warning",
        "Response latency above threshold",
        "Check the route between acquirer and issuer.",
    ),
    (
        "R3",
        "warning",
        "Security module command without reply",
        "Check that the security module is reachable.",
    ),
    (
        "R4",
        "error",
        "Security module returned an error",
        "Look up the return code of the security module.",
    ),
)


def parse_trace(lines: DataFrame) -> DataFrame:
    """TRC-1: one row per line, nothing dropped; what a line lacks is null."""
    line = F.col("line")
    code = F.coalesce(value_after(line, " cmd="), value_after(line, " rsp="))
    fields = lines.select(
        line_time(line).alias("ts"),
        line_kind(line).alias("kind"),
        field(line, "037").alias("rrn"),
        field(line, "002").alias("card"),
        field(line, "003").alias("processing_code"),
        field(line, "039").alias("response_code"),
        code.alias("hsm_code"),
        value_after(line, " xid=").alias("xid"),
        value_after(line, " rc=").alias("hsm_return"),
    )
    return fields.withColumn("card", masked_card(F.col("card")))


def _first(kind: str, *values: str) -> Column:
    """Time and values of the earliest line of a kind; of undated lines only if
    there is no dated one."""
    entry = F.struct(F.col("ts").isNull().alias("undated"), F.col("ts"), *[F.col(v) for v in values])
    return F.min(F.when(F.col("kind") == kind, entry))


def _reply(kind: str, begin: str, *values: str) -> Column:
    """Time and values of the earliest dated line of a kind that is not before
    ``begin``; without a dated beginning, of the earliest dated one."""
    entry = F.struct(F.col("ts"), *[F.col(v) for v in values])
    belongs = F.coalesce(F.col("ts") >= F.col(begin), F.col(begin).isNull() & F.col("ts").isNotNull())
    return F.min(F.when((F.col("kind") == kind) & belongs, entry))


def transactions(parsed: DataFrame) -> DataFrame:
    """TRC-2, JON-6, AGG-8, AGG-9: one card per FLD 037.

    The request of each number is found first, by a partially aggregated
    group-by, and joined to the lines, where Spark can split a number with very
    many lines; then the earliest reply that is not before it counts. Undated
    lines pair with nothing and are counted.
    """
    lines = parsed.where("rrn IS NOT NULL")
    requests = (
        lines.where(F.col("kind") == REQUEST)
        .groupBy("rrn")
        .agg(_first(REQUEST, "card", "processing_code").alias("request"))
        .select("rrn", "request", F.col("request.ts").alias("request_ts"))
    )
    paired = (
        lines.join(requests, "rrn", "left")
        .groupBy("rrn")
        .agg(
            F.first("request", ignorenulls=True).alias("request"),
            _reply(RESPONSE, "request_ts", "response_code").alias("response"),
            _reply(REVERSAL, "request_ts", "response_code").alias("reversal"),
            F.max(F.when(F.col("hsm_return") != APPROVED, 1).otherwise(0)).alias("hsm_failed"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    status = (
        F.when(
            F.col("reversal").isNotNull()
            | (F.col("response.response_code") != APPROVED)
            | (F.col("hsm_failed") == 1),
            F.lit("ERROR"),
        )
        .when(F.col("response.response_code") == APPROVED, F.lit("OK"))
        .otherwise(F.lit("UNKNOWN"))
    )
    return paired.select(
        "rrn",
        F.col("request.card").alias("card"),
        F.col("request.processing_code").alias("processing_code"),
        F.col("request.ts").alias("request_ts"),
        F.col("response.ts").alias("response_ts"),
        F.col("response.response_code").alias("response_code"),
        F.col("reversal.ts").alias("reversal_ts"),
        F.col("reversal.response_code").alias("reversal_code"),
        millis_between(F.col("request.ts"), F.col("response.ts")).alias("latency_ms"),
        status.alias("status"),
        "n_lines",
    )


def story(parsed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """TRC-3, WIN-5: the lines of each transaction as numbered sentences. Only a
    very long transaction has more than one ``part``."""
    lines = parsed.where("rrn IS NOT NULL").select(
        "rrn",
        "ts",
        kind_rank(F.col("kind")).alias("rank"),
        "kind",
        "xid",
        function_name(F.col("kind")).alias("function"),
        sentence(
            F.col("kind"),
            F.coalesce("response_code", "hsm_return"),
            F.col("hsm_code"),
        ).alias("sentence"),
    )
    ties = ["rank", "xid", "sentence"]
    numbered = number_rows(
        lines, "rrn", "ts", ties, "step", hot_rows, keep_part=True
    )
    return numbered.select("rrn", "part", "step", "ts", "function", "sentence")


def hsm_exchanges(parsed: DataFrame) -> DataFrame:
    """TRC-4, JON-7: each command with its reply, if any. A dated reply before the
    command is none; an undated one counts where no dated one does."""
    hsm = parsed.where(F.col("kind").isin(COMMAND, REPLY) & F.col("rrn").isNotNull())
    hsm = hsm.select("rrn", F.coalesce("xid", F.lit("")).alias("xid"), "kind", "ts", "hsm_code", "hsm_return")
    commands = (
        hsm.where(F.col("kind") == COMMAND)
        .groupBy("rrn", "xid")
        .agg(_first(COMMAND, "hsm_code").alias("command"))
        .select("rrn", "xid", "command", F.col("command.ts").alias("command_ts"))
    )
    undated = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.col("hsm_code"), F.col("hsm_return"))
    grouped = (
        commands.join(hsm.where(F.col("kind") == REPLY).drop("command"), ["rrn", "xid"], "left")
        .groupBy("rrn", "xid", "command")
        .agg(
            _reply(REPLY, "command_ts", "hsm_code", "hsm_return").alias("dated"),
            F.min(F.when((F.col("kind") == REPLY) & F.col("ts").isNull(), undated)).alias("undated"),
        )
        .withColumn("reply", F.coalesce("dated", "undated"))
    )
    return grouped.select(
        "rrn",
        "xid",
        F.col("command.hsm_code").alias("command"),
        F.col("command.ts").alias("command_ts"),
        F.col("reply.hsm_code").alias("reply"),
        F.col("reply.ts").alias("reply_ts"),
        F.col("reply.hsm_return").alias("hsm_return"),
        F.col("reply").isNotNull().alias("replied"),
    )


def _rule_value(place: int) -> Column:
    value = F.lit(None).cast("string")
    for rule in RULES:
        value = F.when(F.col("rule") == rule[0], F.lit(rule[place])).otherwise(value)
    return value


def _found(**rules: Column) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]))


def card_rules() -> Column:
    """TRC-5, TRC-6, over a transaction card."""
    no_code = (
        F.col("reversal_ts").isNotNull()
        & F.col("reversal_code").isNull()
        & (F.col("response_code") == APPROVED)
    )
    return _found(R1=no_code, R2=F.col("latency_ms") > LATENCY_LIMIT_MS)


def exchange_rules() -> Column:
    """TRC-7, over a security-module exchange."""
    failed = F.col("hsm_return") != APPROVED
    return _found(R3=~F.col("replied"), R4=failed)


def inconsistencies(cards: DataFrame, exchanges: DataFrame) -> DataFrame:
    """The broken rules of each transaction, one row each."""
    none = F.lit("")
    of_cards = cards.select("rrn", none.alias("xid"), F.explode(card_rules()).alias("rule"))
    of_exchanges = exchanges.select(
        "rrn",
        F.coalesce("xid", none).alias("xid"),
        F.explode(exchange_rules()).alias("rule"),
    )
    return of_cards.unionByName(of_exchanges).select(
        "rrn",
        "xid",
        "rule",
        _rule_value(1).alias("severity"),
        _rule_value(2).alias("title"),
    )


def with_rules(cards: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Each card with the distinct rules that it breaks, at most one of each."""
    broken = exchanges.select("rrn", F.explode(exchange_rules()).alias("rule"))
    of_exchanges = broken.groupBy("rrn").agg(F.collect_set("rule").alias("more"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    rules = F.sort_array(F.concat(card_rules(), more))
    return cards.join(of_exchanges, "rrn", "left").withColumn("rules", rules).drop("more")


def status_counts(cards: DataFrame) -> DataFrame:
    """AGG-7."""
    return cards.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_transactions"), F.sum("n_lines").alias("n_lines")
    )


def trace_summary(
    parsed: DataFrame, cards: DataFrame, issues: DataFrame
) -> DataFrame:
    """TRC-8: one row of counts, and the sentence made from them."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy().agg(F.count(F.lit(1)).alias(name))

    counts = [
        counted(parsed, "n_entries"),
        counted(cards, "n_transactions"),
        counted(issues, "n_issues"),
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    totals = union.groupBy().agg(
        *[F.max(n).alias(n) for n in ("n_entries", "n_transactions", "n_issues")]
    )
    return totals.withColumn("summary", _summary_text())


def _summary_text() -> Column:
    return F.concat(
        F.lit("Analyzed "),
        F.format_number("n_entries", 0),
        F.lit(" log entries in "),
        F.format_number("n_transactions", 0),
        F.lit(" transactions and found "),
        F.format_number("n_issues", 0),
        F.lit(" non-conformities."),
    )


def code_meanings(parsed: DataFrame, codes: DataFrame) -> DataFrame:
    """JON-8: what the message type and the response code of a line mean. The
    code table is fixed and broadcast."""

    def named(kind: str, key: str, name: str) -> DataFrame:
        rows = codes.where(F.col("kind") == kind)
        return F.broadcast(
            rows.select(F.col("code").alias(key), F.col("meaning").alias(name))
        )

    joined = parsed.join(named("mti", "kind", "kind_meaning"), "kind", "left").join(
        named("response", "response_code", "response_meaning"), "response_code", "left"
    )
    unknown = F.lit("")
    return joined.withColumns(
        {
            "kind_meaning": F.coalesce("kind_meaning", unknown),
            "response_meaning": F.coalesce("response_meaning", unknown),
        }
    )


def story_pages(steps: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The story of each transaction as arrays of bounded length, each with the
    number of its first step. Parts are gathered where they were numbered."""
    paged = with_page(steps.withColumn("at", F.col("step") - 1), "at", page_rows)
    told = gather_pages(paged, ["rrn", "part"], "at", F.col("sentence"), "story")
    return told.select("rrn", (F.col("first") + 1).alias("first_step"), "story")


def _issue_list(rules: str, evidence: str) -> Column:
    """Rule names as issues of an answer, with the passage that tells of each."""

    def value(name: Column, place: int) -> Column:
        pairs = [F.lit(x) for rule in RULES for x in (rule[0], rule[place])]
        return F.create_map(*pairs)[name]

    return F.transform(
        rules,
        lambda name: F.struct(
            value(name, 1).alias("severity"),
            value(name, 2).alias("title"),
            _passage(evidence, name)["detail"].alias("detail"),
        ),
    )


def _passage(evidence: str, name: Column) -> Column:
    return F.try_element_at(F.col(evidence), name)


def _reference_list(rules: str, evidence: str) -> Column:
    """The distinct sources of the passages, in the order of the rules."""
    found = F.transform(
        rules,
        lambda name: F.when(
            _passage(evidence, name).isNotNull(),
            F.struct(_passage(evidence, name)["source"].alias("source"), F.lit(None).cast("int").alias("page")),
        ),
    )
    return F.array_distinct(F.array_compact(found))


def _evidence_map(evidence: DataFrame) -> Column:
    """One map for all answers: there are as many passages as fixed rules."""
    source = F.coalesce("source", F.lit(""))
    detail = F.concat(F.lit("See document "), F.col("doc_id").cast("string"), F.lit(", "), source, F.lit("."))
    passage = F.struct(source.alias("source"), detail.alias("detail"))
    entries = F.map_from_entries(F.collect_list(F.struct("rule", passage)))
    return evidence.groupBy().agg(entries.alias("evidence")).scalar()


def _advice_list(rules: str) -> Column:
    pairs = [F.lit(x) for rule in RULES for x in (rule[0], rule[3])]
    return F.transform(rules, lambda name: F.create_map(*pairs)[name])


def structured_answers(
    told: DataFrame, cards: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """RET-5, PRJ-6, PRJ-7, STR-4: the answer record of each transaction, one
    row per page of its story (more than one only for very long ones). ``cards``
    carry their rules. With ``evidence`` (rule, doc_id, source; a rule at most once)
    issues name the passage in their detail, and the answer refers to its source."""
    summary = F.concat(
        F.lit("Transaction "),
        F.col("rrn"),
        F.lit(" has status "),
        F.col("status"),
        F.lit(" after "),
        F.col("n_lines").cast("string"),
        F.lit(" log entries."),
    )
    none = F.create_map().cast("map<string,struct<source:string,detail:string>>")
    known = none if evidence is None else _evidence_map(evidence)
    joined = told.join(cards, "rrn").withColumn("evidence", known)
    return joined.select(
        F.col("rrn").alias("conversation_id"),
        "first_step",
        F.lit("log").alias("agent"),
        F.struct(
            summary.alias("summary"),
            "story",
            _issue_list("rules", "evidence").alias("issues"),
            _advice_list("rules").alias("recommendations"),
            _reference_list("rules", "evidence").alias("references"),
        ).alias("answer"),
    )


def agent_summary(agent: Column, question: Column) -> Column:
    """PRJ-7, STR-4: the opening sentence of an answer; every agent but ``log``
    takes the documentation form."""
    return F.when(
        agent == "log", F.lit("Analyzed the provided trace.")
    ).otherwise(
        # Fixed value: the wording around the question.
        F.concat(
            F.lit('Reviewed the available documentation to answer: "'),
            question,
            F.lit('".'),
        )
    )


def report(told: DataFrame, cards: DataFrame) -> DataFrame:
    """TRC-9: a row per transaction (and story page), ready for the JSON sink."""
    return told.join(cards, "rrn")
