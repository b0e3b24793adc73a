"""Written tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.session import work_dir


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the session's shared folder and read again: lineage ends
    here, and a lost executor costs no recomputation of what is before."""
    spark = df.sparkSession
    folder = work_dir(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is named
    by its smallest node. Null ends and loops link nothing; repeats are harmless.

    Alternates large and small stars: every node links its larger neighbours,
    then all its smaller ones, to the smallest node it knows. Minima are combined
    before the shuffle, and the join back is by node, where Spark splits a node
    with very many neighbours. Each half of a round is one join and is written to the
    shared folder: the driver keeps what it compiles for a plan, so plans are short.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = saved(links.distinct(), "links")
    state = None
    for _ in range(max_rounds):
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = current.select(F.inline(F.array(F.struct("a", "b"), turned)))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # A larger neighbour follows to the smallest one; where the other end is smaller,
        # ``a`` itself does.
        large = both.join(least, "a").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "stars")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        current = saved(joined.where("a <> b").distinct(), "links")
        seen = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("mark"),
        ).first()
        if (seen["n"], seen["mark"]) == state:
            break
        state = (seen["n"], seen["mark"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
