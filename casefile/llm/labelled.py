"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(order, doc_id, text, label, weight) of at most ``per_class`` training
    documents of each label, 0 and 1: those with the smallest hash of their id.

    Ids with a null or any other label, and held-out ids, are not used; an id
    with both labels counts as 1. The chosen ids are at most twice ``per_class``,
    so they are broadcast against one scan of the documents. ``weight`` is how
    many labelled training ids each chosen one stands for: the cap takes the
    labels to even shares, weighted rows keep those of the whole table.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    parts = [
        known.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)
    ]
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    weight = F.col("size") / F.least("size", F.lit(per_class))
    chosen = parts[0].unionByName(parts[1]).join(F.broadcast(sizes), "label")
    chosen = chosen.select("doc_id", "label", "order", weight.alias("weight"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("order", "doc_id", "text", "label", "weight")


def in_order(rows: list) -> list[tuple[str, int]]:
    """(text, label) of sampled rows, in an order that does not depend on tasks."""
    return [(r[2] or "", r[3]) for r in sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))]


def class_weights(rows: list) -> tuple[float, float]:
    """The weight of a sampled row of label 0 and of label 1; 1 for a label
    without rows."""
    found = {r[3]: r[4] for r in rows}
    return found.get(0, 1.0), found.get(1, 1.0)
