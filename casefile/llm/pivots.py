"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots, in order. Similar vectors have
similar descriptions: those that share at least two of their nearest pivots are
candidates. They meet in the inverted list of a pivot pair, and are then verified
by their cosine in double precision. A pair of vectors that shares more pivots
meets in several lists and counts in the first one only.

Pivots come from a bounded sample and are kept apart from each other, because
several pivots in one group of copies would describe its members by noise. Their
number grows with the square root of the table, so lists stay short; every
vector is indexed. Equal vectors are one entry of the index, with their number.
A list longer than a block is cut into blocks, and each two blocks meet in a cell
of their own. A cell returns counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.graph import components, saved
from casefile.operators.groups import broadcast_within

SAMPLE = 8_192
NEAREST = 6
APART = 0.6
BLOCK = 2_000
MAX_LONG_LISTS = 100_000


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that are usable, and their unit vectors in double precision: not null
    or zero, every component finite."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    at, units = [], []
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(valid):
        row = values[offsets[i] : offsets[i + 1]]
        with np.errstate(over="ignore", invalid="ignore"):
            largest = np.abs(row).max() if len(row) else 0.0
            if 0 < largest < np.inf and not np.isnan(row).any():
                row = row / largest
                at.append(i)
                units.append(row / np.sqrt(row @ row))
    return np.array(at, np.int64), units


def choose_pivots(units: np.ndarray, number: int) -> np.ndarray:
    """At most ``number`` rows, in order, no two with a cosine over ``APART``."""
    chosen: list[np.ndarray] = []
    for row in units:
        if not chosen or (np.array(chosen) @ row).max() <= APART:
            chosen.append(row)
            if len(chosen) == number:
                break
    return np.array(chosen)


def _pivots(vectors: DataFrame, number: int) -> dict[int, np.ndarray]:
    """Pivots by width of the vectors, from a sample of fixed length."""
    picked = (
        vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL")
        .orderBy(F.xxhash64("vec_id"), "vec_id")
        .select("embedding")
        .limit(SAMPLE)
        .toArrow()
    )
    column = picked.column(0).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    by_width: dict[int, list[np.ndarray]] = {}
    for unit in unit_rows(column)[1]:
        by_width.setdefault(len(unit), []).append(unit)
    return {w: choose_pivots(np.array(u), number) for w, u in by_width.items()}


def _described(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """(vec_id, mark, near, unit): digest, pivots and unit vector of the usable rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                column = pa.concat_arrays([part.column(1)])
                at, units = unit_rows(column)
                marks, nears = [], []
                for unit in units:
                    marks.append(f"{len(unit)}-" + hashlib.md5(unit.tobytes()).hexdigest())
                    table = shared.value.get(len(unit))
                    if table is None:  # a width that the sample lacks: one list
                        nears.append(np.arange(2, dtype=np.int32).tobytes())
                        continue
                    order = np.argsort(-(table @ unit), kind="stable")[: max(2, nearest)]
                    near = np.append(order, [len(table)])[: max(2, len(order))]
                    nears.append(near.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at, pa.int64())),
                        pa.array(marks, pa.string()),
                        pa.array(nears, pa.binary()),
                        pa.array([u.tobytes() for u in units], pa.binary()),
                    ],
                    names=["vec_id", "mark", "near", "unit"],
                )

    schema = f"vec_id {kind}, mark string, near binary, unit binary"
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def _listed(entries: DataFrame) -> DataFrame:
    """One row per entry and pair of its pivots: (width, low, high, mark, size, near, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, low, high = [], [], []
                for i, near in enumerate(part.column(2).to_pylist()):
                    for a, b in combinations(sorted(np.frombuffer(near, np.int32).tolist()), 2):
                        rows.append(i)
                        low.append(a)
                        high.append(b)
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low, pa.int32()), pa.array(high, pa.int32()), *taken.columns],
                    names=["low", "high", *taken.schema.names],
                )

    return entries.select("mark", "size", "near", "unit").mapInArrow(
        run, "low int, high int, mark string, size bigint, near binary, unit binary"
    )


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two smallest numbers that rows of ``a`` (sorted) share with rows of ``b``."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    order = np.argsort(~same, axis=1, kind="stable")[:, :2]
    return np.take_along_axis(a, order, axis=1)


def _cell(low: int, high: int, own: bool, rows: list[tuple], least: float) -> Iterator[tuple]:
    """(mark, links, root): of each entry of a cell that has verified partners
    whose first list this is. Rows are (side, mark, size, near, unit)."""
    left = [r for r in rows if own or r[0] == 0]
    right = left if own else [r for r in rows if r[0] == 1]
    if not left or not right or (own and len(left) < 2):
        return
    n = len(left) + (0 if own else len(right))
    marks = [r[1] for r in left] + ([] if own else [r[1] for r in right])
    counts = np.zeros(n, np.int64)
    root = np.arange(n)
    offset = 0 if own else len(left)
    size = np.array([r[2] for r in right])
    near_right = np.array([np.sort(np.frombuffer(r[3], np.int32)) for r in right])
    matrix = np.array([np.frombuffer(r[4]) for r in right]).T
    step = max(1, 200_000 // len(right))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        cosine = np.array([np.frombuffer(r[4]) for r in part]) @ matrix
        i, j = np.nonzero(cosine >= least)
        if own:
            i, j = i[i + at < j], j[i + at < j]
        if not len(i):
            continue
        near_left = np.array([np.sort(np.frombuffer(r[3], np.int32)) for r in part])
        pair = _first_shared(near_left[i], near_right[j])
        here = (pair[:, 0] == low) & (pair[:, 1] == high)
        i, j = i[here] + at, j[here]
        np.add.at(counts, i, size[j])
        np.add.at(counts, j + offset, np.array([left[x][2] for x in i], np.int64))
        j = j + offset
        # Smaller roots win until every link is inside one tree.
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
            while (root[root] != root).any():
                root = root[root]
    for k in np.flatnonzero(counts):
        yield marks[k], int(counts[k]), marks[root[k]]


def _verified(cells: DataFrame, least: float) -> DataFrame:
    """Cells are read in order, one at a time."""
    schema = pa.schema([("mark", pa.string()), ("links", pa.int64()), ("root", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:5] != key:
                    if key:
                        out += _cell(key[1], key[2], key[3] == key[4], rows, least)
                    key, rows = r[:5], []
                rows.append(r[5:])
            if len(out) > 5000:
                yield pack()
                out = []
        if key:
            out += _cell(key[1], key[2], key[3] == key[4], rows, least)
        yield pack()

    ordered = cells.repartition("width", "low", "high", "i", "j").sortWithinPartitions("width", "low", "high", "i", "j")
    columns = ["width", "low", "high", "i", "j", "side", "mark", "size", "near", "unit"]
    return ordered.select(*columns).mapInArrow(run, "mark string, links bigint, root string")


def near_vectors(
    vectors: DataFrame, least: float = 0.95, pivots: int | None = None, nearest: int = NEAREST
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Two vectors link when they share two of their ``nearest`` pivots and their
    cosine is at least ``least``: no pair below it links, and near pairs that share
    fewer pivots are missed. Vectors of different width never link. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without
    an id, link with nothing. Other columns are not read. ``n_links`` counts the
    other rows linked directly, copies too; ``component_id`` is the smallest id
    reachable by links, and ``kept`` says that it is the row's own.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # A null component would become NaN in the arrays.
    rows = rows.withColumn(
        "embedding", F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    )
    number = pivots or int(max(128, 1.2 * rows.count() ** 0.5))
    known = _described(rows.where("vec_id IS NOT NULL"), _pivots(rows, number), nearest)
    described = saved(known, "vectors")
    entries = described.groupBy("mark").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"), F.first("near").alias("near"), F.first("unit").alias("unit")
    )
    listed = saved(_listed(entries), "lists").withColumn("width", F.length("unit"))
    long = (
        listed.groupBy("width", "low", "high")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > BLOCK)
        .select("width", "low", "high", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    )
    long = broadcast_within(long, long, MAX_LONG_LISTS)
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("mark"), blocks.cast("bigint")).cast("int")
    cells = (
        listed.join(long, ["width", "low", "high"], "left")
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(
            "width", "low", "high", "mark", "size", "near", "unit",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )
    found = saved(_verified(cells, least), "verified")
    counts = found.groupBy("mark").agg(F.sum("links").alias("links"))
    members = components(found.select(F.col("mark").alias("a"), F.col("root").alias("b")))
    firsts = described.groupBy("mark").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
    rooted = firsts.join(members.withColumnRenamed("node", "mark"), "mark", "left").withColumn(
        "component", F.coalesce("component", "mark")
    )
    smallest = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = (
        rooted.join(smallest, "component")
        .join(counts, "mark", "left")
        .select("mark", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    usable = described.select("vec_id", "mark").join(named, "mark").select("vec_id", "n_links", "component_id")
    # Rows that were not described: each stands alone.
    bad = (
        F.col("vec_id").isNull()
        | F.col("embedding").isNull()
        | ~F.exists("embedding", lambda x: x != 0)
        | F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    )
    alone = rows.where(F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return usable.unionByName(alone).select(
        "vec_id",
        F.col("n_links").cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
