"""Per-key work that stays spread out when one key holds most of the rows.

Keys with more than ``hot_rows`` rows are found by a partially aggregated count
and cut into parts of consecutive times, so that windows are partitioned by
(key, part). The other keys have a single part. Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
# The hot-key table is broadcast, so its length is fixed. A large key beyond
# this list keeps its single part, at most 1/MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 10_000
PAGE_ROWS = 1000
# Rows of one task where keys are dealt to tasks, and ranges of hashes that are counted.
TASK_ROWS = 500_000
HASH_RANGES = 1 << 16


def hot_keys(df: DataFrame, keys: list[str], time: str, hot_rows: int) -> DataFrame:
    """The largest keys: (keys, start, width of a part in microseconds)."""
    # The same filter that Spark infers for an inner join: one shuffle of counts
    # then serves all joins to this table.
    filled = df.where(F.col(keys[0]).isNotNull())
    sizes = filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.unix_micros(time)).alias("start"),
        F.max(F.unix_micros(time)).alias("end"),
    )
    parts = F.ceil(F.col("size") / F.lit(hot_rows))
    return (
        sizes.where(F.col("size") > hot_rows)
        .orderBy(F.desc("size"), *keys)
        .limit(MAX_HOT_KEYS)
        .select(
            *keys,
            F.col("start").alias("hot_start"),
            F.ceil((F.col("end") - F.col("start") + 1) / parts).alias("hot_width"),
        )
    )


def _place(time: str) -> Column:
    """Number of the even time slice of its hot key that a row is in, else 0."""
    offset = F.unix_micros(time) - F.col("hot_start")
    return F.coalesce(F.call_function("div", offset, F.col("hot_width")), F.lit(0))


def _with_part(df: DataFrame, key: str, time: str, hot_rows: int) -> DataFrame:
    """Adds ``is_hot`` and ``part``: an earlier row is never in a later part.

    Even time slices leave a burst in one slice, so slices that are still too
    large are cut once more. A part is the pair of both slice numbers.
    """
    hot = F.broadcast(hot_keys(df, [key], time, hot_rows))
    sliced = df.join(hot, key, "left").select(
        *df.columns, F.col("hot_width").isNotNull().alias("is_hot"), _place(time).alias("slice")
    )
    crowded = hot_keys(sliced.where("is_hot"), [key, "slice"], time, hot_rows)
    return sliced.join(F.broadcast(crowded), [key, "slice"], "left").select(
        *df.columns, "is_hot", F.struct("slice", _place(time).alias("cut")).alias("part")
    )


def _rows_before(marked: DataFrame, key: str, newest: bool) -> DataFrame:
    """Rows of the preceding parts, for the parts of hot keys that have any."""
    counts = (
        marked.where("is_hot")
        .groupBy(key, "part")
        .agg(F.count(F.lit(1)).alias("part_size"))
    )
    order = F.desc("part") if newest else F.asc("part")
    window = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.sum("part_size").over(window)
    return counts.select(key, "part", before.alias("before")).where("before > 0")


def number_rows(
    df: DataFrame,
    key: str,
    time: str,
    ties: list[str],
    name: str,
    hot_rows: int = HOT_ROWS,
    newest: bool = False,
    limit: int | None = None,
    keep_part: bool = False,
) -> DataFrame:
    """1-based place of each row of its key, by ``time`` then ``ties``, up to
    ``limit`` if given; ``newest`` numbers from the end. Without a limit the
    result is partitioned by (key, part), which ``keep_part`` lets a later step use."""
    direction = F.desc if newest else F.asc
    order = [direction(c) for c in [time, *ties]]
    if limit is not None:
        # Spark cuts every key to the limit within each task before it shuffles,
        # so a hot key needs no parts.
        place = F.row_number().over(W.partitionBy(key).orderBy(*order))
        return df.withColumn(name, place).where(F.col(name) <= limit)
    marked = _with_part(df, key, time, hot_rows)
    within = F.row_number().over(W.partitionBy(key, "part").orderBy(*order))
    rows = marked.withColumn("within", within)
    before = F.coalesce(F.col("before"), F.lit(0))
    kept = [*df.columns, "part"] if keep_part else df.columns
    return rows.join(_rows_before(marked, key, newest), [key, "part"], "left").select(
        *kept, (F.col("within") + before).alias(name)
    )


def with_preceding(
    df: DataFrame,
    key: str,
    time: str,
    ties: list[str],
    item: Column,
    count: int,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds the array of ``item`` of the ``count`` rows before each row.

    A hot key is cut into blocks of consecutive rows; the last ``count`` rows
    of a block are also given to the next one, where they serve as context only.
    """

    def context(*keys: str, order: list[str]) -> Column:
        frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(-count, -1)
        return F.collect_list(item).over(frame)

    marked = _with_part(df, key, time, hot_rows)
    ordinary = marked.where("NOT is_hot").select(*df.columns)
    plain = ordinary.withColumn(name, context(key, order=[time, *ties]))

    hot = marked.where("is_hot").select(*df.columns)
    size = max(hot_rows, count)
    index = F.col("place") - 1
    home = F.call_function("div", index, F.lit(size))
    shared = (index % size) >= size - count
    blocks = F.when(shared, F.array(home, home + 1)).otherwise(F.array(home))
    blocked = (
        number_rows(hot, key, time, ties, "place", hot_rows)
        .select("*", home.alias("home"), F.explode(blocks).alias("block"))
        .withColumn(name, context(key, "block", order=["place"]))
        .where(F.col("block") == F.col("home"))
        .drop("place", "home", "block")
    )
    return plain.unionByName(blocked)


def with_page(df: DataFrame, position: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Adds the number of the page, of fixed length, that a position falls on."""
    page = F.call_function("div", F.col(position), F.lit(page_rows))
    return df.withColumn("page", page.cast("bigint"))


def gather_pages(
    paged: DataFrame, keys: list[str], position: str, item: Column, name: str
) -> DataFrame:
    """Gathers ``item`` per key and page in ``position`` order.

    Positions are whole numbers from 0, unique within a key, so an array never
    outgrows a page however large the key is. ``first`` is the position of a
    page's first item.
    """
    entry = F.struct(F.col(position).alias("at"), item.alias("item"))
    gathered = paged.groupBy(*keys, "page").agg(
        F.sort_array(F.collect_list(entry)).alias("entries")
    )
    return gathered.select(
        *keys,
        "page",
        F.col("entries")[0]["at"].alias("first"),
        F.transform("entries", lambda e: e["item"]).alias(name),
    )


def broadcast_within(df: DataFrame, probe: DataFrame, max_rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if ``probe``, whose length bounds it, has at
    most ``max_rows`` rows; otherwise the join is left to shuffle."""
    return F.broadcast(df) if fits(probe, max_rows) else df


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; no more than that are counted."""
    return df.limit(max_rows + 1).count() <= max_rows


def dealt_by(df: DataFrame, key: str, task_rows: int = TASK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` dealt by ``key`` to as many tasks as keep each at about ``task_rows``,
    however large ``df`` is; what then goes by the key shuffles no more. Where a key
    (or no key at all) may have more than ``hot_rows`` rows, ``df`` is left as it is,
    so that Spark can split that key. ``df`` is read once more, for counts."""
    spread = F.pmod(F.xxhash64(key), F.lit(HASH_RANGES)).alias("range")
    sizes = df.groupBy(spread).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if found["rows"] is None or found["most"] > hot_rows:
        return df
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-found["rows"] // task_rows))
    return df.repartition(parts, key)
