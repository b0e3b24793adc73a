"""Similarity join of documents on word shingles, by vertical partitioning.

A document is the set of its distinct shingles, as 64-bit hashes. All shingles
have one global order: rare ones first, by the level of their count, then by hash.
Two sets that are alike enough share a shingle among the first ones of each, their
prefixes, so only documents that meet in a prefix can link. Where they first meet
bounds what they can share from there on, which rules out most pairs.

The global order is cut into fragments, ranges of ranks that hold about as many
shingles each. For a pair to be checked, each fragment counts its own part of the
overlap, and the parts are summed by pair.

Before that, a pair's parities are compared. A set has one bit per bucket, whether
the bucket holds an odd number of its shingles; bits that differ are at most as many
as the shingles that only one of both has, so too many of them rule a link out. They
take a thirtieth of the set, and only what they leave moves whole sets.

Groups of copies are never expanded into pairs. Equal sets are one class from
the start. Then, round by round, the classes that meet at a shingle are compared
with a few of them, hubs, unless both are already connected; each class is checked
against the hub whose parities are closest, and what links is merged. At last every
pair that is still unconnected is checked, so components are exact: a skipped pair
is one whose ends are connected anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casefile.llm.chunks import in_chunks, mix, shingle_hashes, words_of
from casefile.llm.graph import components, saved
from casefile.operators.groups import broadcast_within

WIDTH = 5
FRAGMENTS = 8
# A task looks for common shingles among this many at a time.
WINDOW = 2_000_000
# The list of common shingles goes to every task. It only orders shingles, so
# its bound has no effect on results.
MAX_COMMON = 1_000_000
MAX_BROADCAST_IDS = 1_000_000
HUB_ROUNDS = 2
HUBS = 4
# Parities have two to four bits a shingle up to this many; past it they rule out less.
MAX_BITS = 1 << 20


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text) of the distinct shingles, by text; and by text their
    number and a hash of the set."""
    hashes, doc = shingle_hashes(words_of(texts, fold=True), WIDTH)
    hashes = hashes.view(np.int64)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(hashes) != 0) | (np.diff(doc) != 0)
    hashes, doc = hashes[new], doc[new]
    size = np.bincount(doc, minlength=len(texts))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes.view(np.uint64)), dtype=np.uint64)))
        end = np.cumsum(size)
        mark = mix(total[end] - total[end - size] + size.astype(np.uint64))
    return hashes, doc, size, mark.view(np.int64)


def _parities(hashes: np.ndarray, doc: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For every set one bit per bucket: whether it holds an odd number of shingles.
    A bucket is the low bits of the hash, so halves fold onto each other."""
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 64, MAX_BITS)
    end = np.cumsum(bits)
    at = (end - bits)[doc] + (hashes & (bits[doc] - 1))
    odd = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[(b - n) // 8 : b // 8] for b, n in zip(end.tolist(), bits.tolist(), strict=True)]


def _apart(one: bytes, other: bytes) -> int:
    """The bits that differ, the longer folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint64) for v in (one, other))
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _scan(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from one pass: (doc_id, n, mark) of every document, with
    the parities of its set once per window of a task, and (token, n) of shingles
    that several sets of a window hold."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, mark bigint, token bigint, odd binary"

    def common(window: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        token, count = np.unique(np.concatenate(window), return_counts=True)
        return token[count > 1], count[count > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[np.ndarray] = []
        held, seen = 0, set()
        id_type = None

        def flush() -> pa.RecordBatch:
            token, count = common(window)
            size = len(token)
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(size, id_type),
                    pa.array(count, pa.int64()),
                    pa.nulls(size, pa.int64()),
                    pa.array(token, pa.int64()),
                    pa.nulls(size, pa.binary()),
                ],
                names=["doc_id", "n", "mark", "token", "odd"],
            )

        for batch in batches:
            id_type, at = batch.column(0).type, 0
            for _, texts in in_chunks([None] * batch.num_rows, batch.column(1).to_pylist()):
                hashes, doc, size, mark = _sets(texts)
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                none = pa.nulls(len(texts), pa.int64())
                fresh = np.array([m not in seen and not seen.add(m) for m in mark.tolist()], bool)
                odd = [v if new else None for v, new in zip(_parities(hashes, doc, size), fresh & (size > 0), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size, pa.int64()), pa.array(mark, pa.int64()), none, pa.array(odd, pa.binary())],
                    names=["doc_id", "n", "mark", "token", "odd"],
                )
                window.append(hashes[fresh[doc]])
                held += len(window[-1])
                if held >= WINDOW:
                    yield flush()
                    window, held, seen = [], 0, set()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _prefixes(docs: DataFrame, shared, percent: int) -> DataFrame:
    """(token, mark, n, place): the first shingles of every set, with their place
    from 0, once per task and set. ``shared`` broadcasts sorted shingles, their levels
    and ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, _), seen = shared.value, set()
        for batch in batches:
            for _, texts in in_chunks([None] * batch.num_rows, batch.column(0).to_pylist()):
                hashes, doc, size, mark = _sets(texts)
                if len(seen) > 200_000:
                    seen = set()
                fresh = np.array([m not in seen and not seen.add(m) for m in mark.tolist()], bool)
                keep = fresh[doc]
                hashes, doc = hashes[keep], doc[keep]
                order = np.lexsort((hashes, _levels(common, hashes), doc))
                hashes, doc = hashes[order], doc[order]
                own = np.where(fresh, size, 0)
                place = np.arange(len(doc)) - (np.cumsum(own) - own)[doc]
                first = place < (size - (percent * size + 99) // 100 + 1)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[first], pa.int64()),
                        pa.array(mark[doc[first]], pa.int64()),
                        pa.array(size[doc[first]], pa.int32()),
                        pa.array(place[first], pa.int32()),
                    ],
                    names=["token", "mark", "n", "place"],
                )

    return docs.select("text").mapInArrow(run, "token bigint, mark bigint, n int, place int")


def _ranks(common: tuple[np.ndarray, np.ndarray], counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """By level the share of all shingles before it and its own share, from the
    ``counts`` of common shingles; hashes spread evenly within a level. The counts
    only balance the fragments: each is a range of the order whatever they are."""
    own = np.bincount(common[1], weights=counts, minlength=64).astype(float)
    own[0] = max(total - own.sum(), 0)
    own /= max(own.sum(), 1)
    return np.cumsum(own) - own, own


def _levels(common: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    late, levels = common
    if not len(late):
        return np.zeros(len(hashes), np.int8)
    at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
    return np.where(late[at] == hashes, levels[at], 0)


def _segments(docs: DataFrame, order) -> DataFrame:
    """(mark, fragment, part): the shingles of each set by fragment, as sorted
    8-byte numbers; of ``docs`` with the mark that their set must have. ``order``
    broadcasts the common shingles with their levels and the ranks of the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for _, texts in in_chunks([None] * batch.num_rows, batch.column(0).to_pylist()):
                hashes, doc, _, mark = _sets(texts)
                right = mark == wanted[at : at + len(texts)]
                at += len(texts)
                hashes, doc = hashes[right[doc]], doc[right[doc]]
                common, (before, own) = order.value
                level = _levels(common, hashes)
                rank = before[level] + own[level] * (hashes / 2.0**64 + 0.5)
                fragment = np.clip((FRAGMENTS * rank).astype(np.int64), 0, FRAGMENTS - 1)
                by_rank = np.lexsort((hashes, fragment, doc))
                hashes, doc, fragment = hashes[by_rank], doc[by_rank], fragment[by_rank]
                cell = doc * FRAGMENTS + fragment
                starts = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0))) if len(cell) else np.zeros(0, int)
                data = hashes.tobytes()
                ends = np.append(starts[1:], len(cell)) if len(cell) else starts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mark[doc[starts]], pa.int64()),
                        pa.array(cell[starts] % FRAGMENTS, pa.int32()),
                        pa.array([data[8 * a : 8 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["mark", "fragment", "part"],
                )

    return docs.select("text", "want").mapInArrow(run, "mark bigint, fragment int, part binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()


def _texts(docs: DataFrame, classes: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, want): one document of each class in ``marks``, and its mark. Ids that
    stand on several rows bring other texts too; those lack the mark."""
    wanted = classes.join(marks, "mark").select(F.col("first").alias("id"), F.col("mark").alias("want"))
    wanted = broadcast_within(wanted, marks, MAX_BROADCAST_IDS)
    # Other columns of the documents may have any name.
    texts = docs.select("doc_id", "text")
    return texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "want")


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b, total of both sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                first, second = (np.frombuffer(v.as_py(), np.int64) for v in (x, y))
                if len(first) > len(second):
                    first, second = second, first
                at = np.minimum(np.searchsorted(second, first), len(second) - 1)
                counts.append(int((second[at] == first).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(counts, pa.int64())],
                names=["a", "b", "total", "fragment", "shared"],
            )

    ends = _ends(pairs)
    used = segments.join(broadcast_within(ends, ends, MAX_BROADCAST_IDS), "mark", "left_semi")
    left = used.select(F.col("mark").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = used.select(F.col("mark").alias("b"), "fragment", F.col("part").alias("part_b"))
    joined = pairs.join(left, "a").join(right, ["b", "fragment"])
    counted = joined.select("a", "b", "total", "fragment", "part_a", "part_b").mapInArrow(
        run, "a bigint, b bigint, total bigint, fragment int, shared bigint"
    )
    # A set written twice counts once.
    parts = counted.groupBy("a", "b", "total", "fragment").agg(F.max("shared").alias("shared"))
    return (
        parts.groupBy("a", "b", "total")
        .agg(F.sum("shared").alias("shared"))
        .where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared")))
        .select("a", "b")
    )


def _near(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (own, a, b, total) that their parities do not rule out, with the bits
    that are ``apart``. Linked sets have at most
    (100 - percent) / (100 + percent) of both sizes that is not shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            apart = pa.array([_apart(x, y) for x, y in ends], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), apart], names=["own", "a", "b", "total", "apart"]
            )

    left = parities.select(F.col("mark").alias("a"), F.col("odd").alias("odd_a"))
    right = parities.select(F.col("mark").alias("b"), F.col("odd").alias("odd_b"))
    joined = pairs.join(left, "a").join(right, "b").select("own", "a", "b", "total", "odd_a", "odd_b")
    measured = joined.mapInArrow(run, "own bigint, a bigint, b bigint, total bigint, apart bigint")
    return measured.where((100 + percent) * F.col("apart") <= (100 - percent) * F.col("total"))


def _pair(one: str, other: str) -> list:
    return [
        F.col(f"{one}.mark").alias("own"),
        F.least(f"{one}.mark", f"{other}.mark").alias("a"),
        F.greatest(f"{one}.mark", f"{other}.mark").alias("b"),
        (F.col(f"{one}.n") + F.col(f"{other}.n")).cast("bigint").alias("total"),
    ]


def _may_link(one: str, other: str, percent: int):
    """Whether two sets that first meet at these places can still share enough.

    At a later meeting the bound is lower, so a pair that could link passes at its
    first one, and a pair that passes nowhere cannot link.
    """
    rest = F.least(*(F.col(f"{side}.n") - F.col(f"{side}.place") for side in (one, other)))
    enough = (100 + percent) * rest >= percent * (F.col(f"{one}.n") + F.col(f"{other}.n"))
    met_before = F.coalesce(F.col(f"{one}.prev") == F.col(f"{other}.prev"), F.lit(False))
    return enough & ~met_before


def similar_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are lower-cased (A to Z); a document's set has its distinct five-word
    shingles, or with fewer words its whole sequence. Documents link when
    100 * |intersection| >= ``percent`` * |union|; ``component_id`` is the smallest
    id reachable by links, itself included. Null, empty and wordless texts have an
    empty set, link with nothing and keep their own id. Texts are read whole.
    Rows with a null id are kept, and never name a component. Other columns are
    not read.
    """
    scanned = saved(_scan(docs), "sets")
    sets = scanned.where("token IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "mark")
    common = (
        scanned.where("token IS NOT NULL")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where("n >= 4")
        .orderBy(F.desc("n"), "token")
        .limit(MAX_COMMON)
        .toArrow()
    )
    token, count = (common.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(token)
    levels = (token[order], np.log2(count[order]).astype(np.int8))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast((levels, _ranks(levels, count[order], total)))
    # One shuffle, by token. A shingle of a single set leaves, and one where no
    # set could be the smaller of a pair, which needs more of its shingles left.
    every = W.partitionBy("token")
    small = ((100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")).cast("int")
    placed = _prefixes(docs, shared, percent).select(
        "*",
        F.min("mark").over(every).alias("low"),
        F.max("mark").over(every).alias("high"),
        F.max(small).over(every).alias("small"),
    )
    meetings = placed.where("low <> high AND small = 1").select("token", "mark", "n", "place").distinct()
    # With the shingle before it that the set meets others at: two sets that have
    # the same one have met there, so a run of shared shingles makes one row.
    in_set = W.partitionBy("mark").orderBy("place")
    meetings = saved(meetings.withColumn("prev", F.lag("token").over(in_set)), "meetings")

    classes = sets.where("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("first"))
    odd = scanned.where("odd IS NOT NULL").join(meetings.select("mark"), "mark", "left_semi")
    parities = saved(odd.groupBy("mark").agg(F.first("odd").alias("odd")), "parities")
    segments, stored = None, None
    links, tested, members = None, None, None
    for turn in range(HUB_ROUNDS + 1):
        if members is None:
            spots = meetings.withColumn("root", F.col("mark"))
        else:
            spots = meetings.join(members, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
            # A shingle whose sets are all connected has no more to tell.
            roots = spots.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
            spots = saved(spots.join(roots.where("low <> high").select("token"), "token", "left_semi"), "spots")
        meetings = spots.drop("root")
        if spots.isEmpty():
            break
        last = turn == HUB_ROUNDS
        if last:
            meet = F.col("x.root") != F.col("y.root")
            pairs = spots.alias("x").join(
                spots.alias("y"),
                (F.col("x.token") == F.col("y.token")) & (F.col("x.mark") < F.col("y.mark")) & meet & _may_link("x", "y", percent),
            )
        else:
            # The number of hubs grows, for sets that link with few of a group.
            drawn = W.partitionBy("token").orderBy("h")
            hubs = (
                spots.withColumn("h", F.xxhash64("mark", F.lit(turn)))
                .withColumn("drawn", F.row_number().over(drawn))
                .where(F.col("drawn") <= HUBS * 16**turn)
                .select("token", "mark", "n", "place", "prev", "root")
            )
            pairs = spots.alias("x").join(
                hubs.alias("y"),
                (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", percent),
            )
        pairs = pairs.select(*_pair("x", "y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _near(pairs, parities, percent)
        if not last:
            # One check a class; where it fails, a later round has the others.
            closest = pairs.groupBy("own").agg(F.min(F.struct("apart", "a", "b", "total")).alias("c"))
            pairs = closest.select("c.a", "c.b", "c.total")
        pairs = saved(pairs.select("a", "b", "total").distinct(), "pairs")
        ends = saved(_ends(pairs) if stored is None else _ends(pairs).join(stored, "mark", "left_anti"), "ends")
        more = saved(_segments(_texts(docs, classes, ends), shared), "segments")
        segments = more if segments is None else segments.unionByName(more)
        stored = ends if stored is None else stored.unionByName(ends)
        found = saved(_overlaps(pairs, segments, percent), "links")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        members = components(links).select(F.col("node").alias("mark"), F.col("component").alias("root"))
        if last:
            break

    named = classes
    if members is not None:
        grouped = classes.join(members, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        roots = grouped.groupBy("root").agg(F.min("first").alias("smallest"))
        named = grouped.join(roots, "root").select("mark", F.col("smallest").alias("first"))
    return sets.join(named, "mark", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"),
    )
