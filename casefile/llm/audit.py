"""Filter interaction audit by difference arrays over permutation ranks.

Permutations of n filters are numbered in lexicographic order, by their Lehmer
code; those that share a prefix of k filters are (n - k)! neighbours. A document
is known by its mask, the set of filters it fails. Where a prefix ends in a
filter of the mask and holds no other one, the documents of that mask leave at
step k, for the whole interval of ranks. So every (part, mask) adds its counts
at the ends of a fixed list of intervals, and running sums over the ranks give
every order at once: no document meets an order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casefile.llm.graph import saved

NAMES = "ABCDE"
# Intervals grow with 2**n * n!; seven filters would have millions.
MAX_FILTERS = 6
WORD = "[^\\x20\\x09-\\x0D]+"


def orders(names: str) -> list[str]:
    """All orders by rank."""
    return ["".join(p) for p in permutations(names)]


def first_rank(prefix: tuple[int, ...], n: int) -> int:
    """The lowest rank of the permutations of 0..n-1 that begin with ``prefix``."""
    rank, left = 0, list(range(n))
    for k, item in enumerate(prefix):
        digit = left.index(item)
        rank += digit * factorial(n - 1 - k)
        left.pop(digit)
    return rank


def intervals(n: int) -> dict[int, list[tuple[int, bool, int, int]]]:
    """By mask: (step, early, begin, end). At ``step`` the filter of every order
    with a rank in [begin, end) fails documents of the mask; ``early`` if one
    before it did already. Neighbouring intervals are one."""
    found: dict[int, list[tuple[int, bool, int, int]]] = {}
    for mask in range(1, 1 << n):
        rows: list[tuple[int, bool, int, int]] = []
        for step in range(1, n + 1):
            width = factorial(n - step)
            ends: dict[bool, list[list[int]]] = {False: [], True: []}
            for prefix in permutations(range(n), step):
                if mask >> prefix[-1] & 1:
                    runs = ends[any(mask >> i & 1 for i in prefix[:-1])]
                    begin = first_rank(prefix, n)
                    if runs and runs[-1][1] == begin:
                        runs[-1][1] += width
                    else:
                        runs.append([begin, begin + width])
            rows += [(step, early, *run) for early, runs in ends.items() for run in runs]
        found[mask] = rows
    return found


def text_mask(text: Column) -> Column:
    """Bits of the failures that a text shows by itself, on its whole length: 1 for
    under 200 words, 2 for under half of the words distinct, 4 for over 3 % of A to
    Z, 8 for a symbol of ``#$%&*|``. ``text`` must not be null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failures = (
        n_words < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n_words,
        100 * capitals > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def text_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and by the filters they
    fail, and how many of them have label quality or toxic 1.

    Bit 16 is a text equal to that of a smaller ``doc_id`` of the whole table.
    Equal texts have one digest and one mask, so rows are counted by (id, part,
    digest) before and by (digest, part, labels) after the labels come in, and the
    smallest id is found among those few counts: a text that very many documents
    have is never gathered. Rows without an id never fail it, nor make others fail;
    rows that repeat the smallest id pass as well. A null text is empty, a null
    part is ''. An id with several labels has a label if one row says 1.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_mask(text).alias("mask"),
    )
    counted = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))) for c in ("quality", "toxic")]
    known = labels.groupBy("doc_id").agg(marks[0].alias("good"), marks[1].alias("toxic")).where("good OR toxic")
    labelled = counted.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    nameless = F.col("doc_id").isNull()
    texts = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(nameless, F.col("n")).otherwise(0)).alias("n_nameless"),
        # One row per id here, so the smallest one brings its own count.
        F.min(F.when(~nameless, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(W.partitionBy("digest"))
    owned = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("own", F.col("n_nameless") + owned)
    both = F.array(
        F.struct("mask", F.col("own").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
    )
    cells = split.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("good").cast("bigint") * F.col("n")).alias("good"),
        F.sum(F.col("toxic").cast("bigint") * F.col("n")).alias("toxic"),
    )


def interactions(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """What every filter does in every order, from counts by (part, mask).

    ``cells`` has part, mask (bit i: fails filter i of ``names``), n, good, toxic;
    several rows of a cell add up. One row per part, ``filter_order`` and ``step``
    (from 1), zeros included: ``kept`` after the step, ``removed`` there,
    ``redundant`` (fail the filter, gone before), ``unique_fails`` (fail nothing
    else), ``good_lost``, ``toxic_lost`` and ``shapley`` (removed by the filter,
    summed over all orders). A part without failures has zeros; no cells, no rows.
    The list of intervals depends on the number of filters alone (at most six).
    """
    n = len(names)
    if not 1 <= n <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters, not {n}")
    spark = cells.sparkSession
    ranks = factorial(n)
    spans = spark.createDataFrame(
        list(intervals(n).items()),
        "mask int, spans array<struct<step:int,early:boolean,begin:int,end:int>>",
    )
    touched = cells.where("mask > 0").join(F.broadcast(spans), "mask")
    open_ = touched.select("part", "n", "good", "toxic", F.inline("spans"))
    counts = ("removed", "redundant", "good_lost", "toxic_lost")

    def change(rank: str, sign: int) -> DataFrame:
        gone = F.when(F.col("early"), 0).otherwise(sign)
        return open_.where(F.col(rank) < ranks).select(
            "part",
            "step",
            F.col(rank).alias("rank"),
            (gone * F.col("n")).alias("removed"),
            ((sign - gone) * F.col("n")).alias("redundant"),
            (gone * F.col("good")).alias("good_lost"),
            (gone * F.col("toxic")).alias("toxic_lost"),
        )

    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]
    parts = cells.groupBy("part").agg(F.sum("n").alias("total"), F.array(*alone).alias("alone"))
    every = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank")
    )
    zeros = every.select("*", *(F.lit(0).cast("bigint").alias(c) for c in counts))
    changes = zeros.unionByName(change("begin", 1)).unionByName(change("end", -1))
    summed = changes.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in counts))
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = summed.select("part", "step", "rank", *(F.sum(c).over(along).alias(c) for c in counts))
    order = F.element_at(F.array(*map(F.lit, orders(names))), F.col("rank") + 1)
    rows = rows.withColumn("filter_order", order)
    rows = rows.withColumn("place", F.instr(F.lit(names), F.col("filter_order").substr(F.col("step"), F.lit(1))))
    steps = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("gone", F.sum("removed").over(steps))
    rows = rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "place")))
    return rows.join(parts, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        "removed",
        "redundant",
        F.element_at("alone", F.col("place")).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five text filters over all ``docs``, by language.

    The counts are written once. Only ``doc_id``, ``text`` and ``lang`` of the
    documents and ``doc_id``, ``quality`` and ``toxic`` of the labels are read.
    """
    return interactions(saved(text_cells(docs, labels), "audit-cells"))
