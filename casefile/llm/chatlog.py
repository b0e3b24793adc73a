"""Chat formatting with collapse of cumulative snapshots.

A logger that stores a conversation after every turn leaves each shorter state
beside the longest. A rolling hash of the turns names every prefix; a
conversation whose own hash is a prefix of a longer one, or that an equal one
with a smaller id repeats, is removed by an anti-join, and what is left is rendered.

The hash after k turns is the sum of the hashes of (place, role, text) of the
first k, so it is a running sum. A long conversation is summed in blocks, which
are then added up, and rendered in parts; no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casefile.llm.graph import saved

BLOCK_TURNS = 4096
PART_TURNS = 1000
WIDE = "decimal(38,0)"


def with_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2): turns in order, from 1, each with two
    64-bit hash sums of the prefix that ends there.

    Order is by turn (nulls first), role and text. Rows without conv_id belong to
    no conversation and are left out; a null role or text counts as empty.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))).alias("block"),
    )
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = (
        rows.withColumn("within", F.row_number().over(inside))
        .join(offsets, ["conv_id", "block"])
        .withColumn("place", F.col("within") + F.col("offset"))
        .withColumn("e1", F.xxhash64("place", "role", "text").cast(WIDE))
        .withColumn("e2", F.xxhash64("text", "place", "role", F.lit(1)).cast(WIDE))
    )
    placed = saved(placed, "turns")
    sums = placed.groupBy("conv_id", "block").agg(F.sum("e1").alias("s1"), F.sum("e2").alias("s2"))
    before = sums.select(
        "conv_id", "block", *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).cast(WIDE).alias(f"b{k}") for k in (1, 2))
    )
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.select("*", *(F.sum(f"e{k}").over(running).alias(f"r{k}") for k in (1, 2)))
        .join(before, ["conv_id", "block"])
        .select(
            "conv_id", "place", "role", "text",
            *((F.col(f"r{k}") + F.col(f"b{k}")).cast(WIDE).alias(f"h{k}") for k in (1, 2)),
        )
    )


def snapshots(prefixes: DataFrame) -> DataFrame:
    """(conv_id): conversations that are a prefix of a longer one, or equal to one
    with a smaller id."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    marked = prefixes.select("conv_id", "place", "h1", "h2").join(sizes, "conv_id")
    ends = marked.where("place = n_turns")
    # Only the prefixes' longest use and the smallest id that ends there matter:
    # both are combined before the shuffle, however common a first turn is.
    known = marked.groupBy("place", "h1", "h2").agg(
        F.max("n_turns").alias("longest"),
        F.min(F.when(F.col("place") == F.col("n_turns"), F.col("conv_id"))).alias("smallest"),
    )
    return (
        ends.join(known, ["place", "h1", "h2"])
        .where((F.col("longest") > F.col("n_turns")) | (F.col("smallest") < F.col("conv_id")))
        .select("conv_id")
    )


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered): maximal conversations as text.

    A turn is ``<|role|>``, a line feed, its text and ``<|end|>``, a line feed. Parts
    have at most 1,000 turns. An empty table gives an empty result.
    """
    prefixes = saved(with_prefixes(turns), "prefixes")
    kept = prefixes.join(snapshots(prefixes), "conv_id", "left_anti")
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    part = F.floor((F.col("place") - 1) / PART_TURNS).cast("int").alias("part")
    gathered = kept.groupBy("conv_id", part).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"),
    )
    return gathered.select(
        "conv_id", "part", "n_turns", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered")
    )
