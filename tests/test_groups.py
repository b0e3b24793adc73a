"""Group work with hot keys must equal the plain form."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casefile.operators import groups
from casefile.operators.groups import (
    gather_pages,
    hot_keys,
    number_rows,
    with_page,
    with_preceding,
)
from casefile.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    """One key with a third of the rows, in bursts and with equal times."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))
    )
    burst = F.when(F.col("id") % 2 == 0, F.col("id") * 1000).otherwise(F.col("id") % 7)
    made = spark.range(600).select(
        "id", hot.alias("key"), F.timestamp_micros(burst).alias("time")
    )
    return made.cache()


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_hot_keys(rows):
    found = hot_keys(rows, ["key"], "time", 50).collect()
    assert [r.key for r in found] == ["hot"]


@pytest.mark.parametrize("hot_rows", [1, 7, 50, 1_000_000])
@pytest.mark.parametrize("newest", [False, True])
def test_number_rows(rows, hot_rows, newest):
    sort = F.desc if newest else F.asc
    window = W.partitionBy("key").orderBy(sort("time"), sort("id"))
    plain = rows.withColumn("place", F.row_number().over(window).cast("bigint"))
    numbered = number_rows(
        rows, "key", "time", ["id"], "place", hot_rows, newest=newest
    )
    assert same(numbered, plain)
    first = number_rows(
        rows, "key", "time", ["id"], "place", hot_rows, newest=newest, limit=9
    )
    assert same(first, plain.where("place <= 9"))


@pytest.mark.parametrize("hot_rows", [1, 7, 50, 1_000_000])
def test_with_preceding(rows, hot_rows):
    window = W.partitionBy("key").orderBy("time", "id").rowsBetween(-3, -1)
    plain = rows.withColumn("before", F.collect_list("id").over(window))
    found = with_preceding(
        rows, "key", "time", ["id"], F.col("id"), 3, "before", hot_rows
    )
    assert same(found, plain)


def test_bursts_are_cut_again(spark):
    """Nearly all rows of a key within a small share of its time span."""
    micros = F.when(F.col("id") == 0, F.lit(10**9)).otherwise(F.col("id"))
    rows = spark.range(1000).select(
        "id", F.lit("k").alias("key"), F.timestamp_micros(micros).alias("time")
    )
    numbered = number_rows(rows, "key", "time", ["id"], "n", 50, keep_part=True)
    largest = numbered.groupBy("part").count().agg(F.max("count")).collect()[0][0]
    assert largest <= 100
    found = {r.id: r.n for r in numbered.collect()}
    assert found == {i: i if i else 1000 for i in range(1000)}


def test_pages_are_bounded_and_whole(spark):
    rows = spark.range(25).select(F.lit("a").alias("key"), F.col("id").alias("at"))
    pages = gather_pages(with_page(rows, "at", 10), ["key"], "at", F.col("at"), "items")
    found = sorted((r.page, r.first, r["items"]) for r in pages.collect())
    assert [len(items) for _, _, items in found] == [10, 10, 5]
    assert [x for _, _, items in found for x in items] == list(range(25))
    assert [first for _, first, _ in found] == [0, 10, 20]


def test_ordinary_keys_need_no_extra_shuffle(rows):
    """Without hot keys the rows are shuffled once; at most an empty broadcast
    table is looked up on the way."""
    numbered = number_rows(rows, "key", "time", ["id"], "place")
    numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    assert "SortMergeJoin" not in final
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+, part", final)) == 1


def test_keys_are_dealt_to_tasks_of_bounded_size(spark):
    """Tasks grow in number, not in size; a hot key, or rows without a key, are left to Spark."""
    rows = spark.range(40_000).selectExpr("concat('k', id % 20000) AS rrn", "id")
    dealt = groups.dealt_by(rows, "rrn", task_rows=1000, hot_rows=500)
    assert dealt.rdd.getNumPartitions() == 40
    largest = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 1500 and dealt.agg(F.sum("id")).first() == rows.agg(F.sum("id")).first()
    for key in ("'k'", "CAST(NULL AS string)"):
        hot = rows.selectExpr(f"IF(id < 600, {key}, rrn) AS rrn")
        assert groups.dealt_by(hot, "rrn", task_rows=1000, hot_rows=500) is hot
    none = rows.where("false")
    assert groups.dealt_by(none, "rrn") is none


def test_a_trace_is_parsed_once(spark):
    """The lines of a query that reads them several times are cut only as they are written."""
    plan = catalog.trace_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" not in plan
