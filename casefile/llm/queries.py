"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import (
    audit,
    chatlog,
    jaccard,
    mixing,
    pieces,
    pii,
    pivots,
    ranking,
    repetition,
    resample,
    sql,
    tokenfile,
    toxicity,
    urls,
)
from casefile.llm.labelled import held_out
from casefile.session import work_dir
from casefile.sources.tables import read_table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def op1_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return chatlog.render(read_table(spark, folder, "conversations"))


def op2_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(read_table(spark, folder, "documents"))


def op3_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = ranking.train(docs, read_table(spark, folder, "labels"))
    return ranking.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = toxicity.train(docs, read_table(spark, folder, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("is_toxic").cast("int").alias("predicted"),
    )


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path(PIECE_MODEL), digests=True)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled"
    )


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read_table(spark, folder, "pages"), urls.rule_table(spark))


def op8_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(read_table(spark, folder, "embeddings"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(read_table(spark, folder, "documents"))


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_components(read_table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    files = work_dir(spark, "token-files")
    tokenfile.write(read_table(spark, folder, "documents"), files, public_tokenizers.path(WORD_MODEL))
    return tokenfile.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_snapshots,
        op2_repetition,
        op3_quality_ranking,
        op4_toxicity,
        op5_pieces,
        op6_mixing,
        op7_urls,
        op8_pivots,
        op9_pii,
        op10_jaccard,
        op11_filter_audit,
        op12_repair,
        op13_resample,
    )
}
ORACLE: dict[str, str] = sql.statements()
