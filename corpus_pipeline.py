"""The corpus pipeline: each stage's rows are written and are the next one's input.

Every stage keeps the columns of ``documents``; the last adds its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import jaccard, mixing, pieces, pii, toxicity
from casefile.llm.graph import saved
from casefile.llm.queries import PIECE_MODEL
from casefile.operators.groups import broadcast_within
from casefile.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose toxicity is 0.7 or more."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("NOT is_toxic").select(docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id stays.

    Texts without words are no group and stay. Rows that repeat both id and text
    become one.
    """
    found = saved(jaccard.similar_components(docs), "similar")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(stays).alias("stays"))
    gone = by_id.where("NOT stays").select("doc_id")
    gone = broadcast_within(gone, gone, jaccard.MAX_BROADCAST_IDS)
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    repeated = by_id.where("rows > 1 AND stays").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = broadcast_within(repeated, repeated, jaccard.MAX_BROADCAST_IDS)
    same = docs["doc_id"].eqNullSafe(repeated["doc_id"])
    once = kept.join(repeated, same, "left_anti")
    more = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of every span of personal data."""
    text = pii.redacted(F.col("text"), F.col("pii"))
    changed = pii.with_spans(docs).withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return changed.select(docs.columns)


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the probabilities of the raked mixture."""
    return mixing.mix(docs).where("sampled").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, their number and the decoded text."""
    return pieces.encode(docs, public_tokenizers.path(PIECE_MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("similar", drop_similar),
    ("pii", redact),
    ("mixing", sample_mix),
    ("pieces", encode),
]
# Fitted models, similarity groups and tokenization are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
