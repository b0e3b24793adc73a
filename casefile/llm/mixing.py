"""Mixing by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked: scaled to the
target of every source, then of every language, then of every topic, again and
again. A document is sampled with the probability that gives its cell the raked
share of the token budget; where a cell has too few tokens, all of it is taken
and the others share the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casefile.llm.graph import saved

DIMENSIONS = ("source", "lang", "topic")
# A target share is proportional to the tokens to this power.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS = 12
FILLS = 6
BUDGET = 0.8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def length_topic(words: Column) -> Column:
    """The tables have no topics; the form of a text, by its length, stands in."""
    return F.when(words < 100, "note").when(words < 1000, "article").otherwise("long")


def tempered_targets(cells: DataFrame, temper: dict[str, float] = TEMPER) -> dict[str, DataFrame]:
    """Target shares of every value of every dimension, from its tokens."""
    out = {}
    for name in DIMENSIONS:
        powers = cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper[name])).alias("power"))
        whole = powers.agg(F.sum("power")).first()[0] or 1.0
        out[name] = powers.select(name, (F.col("power") / whole).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the dimensions, tokens) with ``weight``, the raked share of each.

    Sums by dimension are windows over the cells, a small table, so nothing is
    joined or broadcast but the targets, once; the table is written after every
    round, so a plan never spans two rounds.
    """
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    current = cells.withColumn("weight", F.col("tokens") / whole)
    for name in DIMENSIONS:
        current = current.join(targets[name].withColumnRenamed("target", f"target_{name}"), name)
    for _ in range(rounds):
        for name in DIMENSIONS:
            have = F.sum("weight").over(W.partitionBy(name))
            current = current.withColumn("weight", F.col("weight") * F.col(f"target_{name}") / have)
        current = saved(current, "raked")
    return current.select(*DIMENSIONS, "tokens", "weight")


def probabilities(raked: DataFrame, budget: float = BUDGET, fills: int = FILLS) -> DataFrame:
    """Adds the sampling ``probability`` that spends ``budget`` of all tokens.

    Cells at 1 stay there; each filling scales the others to what is left.
    """
    current = raked.withColumn("probability", F.lit(0.0))
    ratio = F.col("weight") / F.col("tokens")
    for _ in range(fills):
        full = F.col("probability") >= 1
        whole, spent, free = current.agg(
            F.sum("tokens"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        scale = max(0.0, budget * whole - spent) / free if free else 0.0
        current = current.withColumn(
            "probability", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), ratio * scale))
        )
    return current


def uniform(id_column: str = "doc_id") -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    head = F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, budget: float = BUDGET, topic: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens``, ``topic``, the raked ``weight`` of its
    cell, its ``probability`` and whether it is ``sampled``; columns named like
    these are replaced.

    Tokens are words of whole texts; null and empty texts have none and are not
    sampled. A null source, language or topic is a value like any other, shown
    as empty. Rows with equal ids are sampled together. The counts are of all
    rows; the table of cells is broadcast only where Spark finds it small.
    """
    added = ("n_tokens", "topic", "weight", "probability", "sampled")
    words = word_count(F.col("text"))
    counted = docs.drop(*added).withColumn("n_tokens", words)
    given = topic if topic is not None else length_topic(F.col("n_tokens"))
    keys = {"source": F.col("source"), "lang": F.col("lang"), "topic": given}
    keyed = counted.withColumns({f"__{k}": F.coalesce(v.cast("string"), F.lit("")) for k, v in keys.items()})
    measured = keyed.groupBy(*(F.col(f"__{k}").alias(k) for k in keys)).agg(F.sum("n_tokens").alias("tokens"))
    cells = saved(measured.where("tokens > 0"), "cells")
    targets = {k: saved(v, f"targets-{k}") for k, v in tempered_targets(cells).items()}
    shares = saved(probabilities(rake(cells, targets), budget), "shares").select(
        *(F.col(k).alias(f"__{k}") for k in keys), "weight", "probability"
    )
    joined = keyed.join(shares, [f"__{k}" for k in keys], "left")
    chance = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    out = joined.withColumns(
        {"topic": F.col("__topic"), "weight": F.coalesce("weight", F.lit(0.0)), "probability": chance}
    ).withColumn("sampled", uniform() < F.col("probability"))
    return out.drop(*(f"__{k}" for k in keys))
