"""Target-distribution importance resampling with an exact parallel sort.

Word n-grams are hashed into buckets; a table of gains, one per bucket, tells how
much likelier the bucket is in the target than in the corpus, and a document's
weight is the sum over its n-grams. The highest scores (weight plus Gumbel noise
from the id) are drawn by sorting with regular sampling: every run is sorted where
it lies and gives evenly spaced keys, the sorted keys give splitters, counts of the
segments between splitters give the rank at which each segment begins, and only
the segments that reach into the draw move, to be merged and numbered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.chunks import in_chunks
from casefile.llm.graph import saved

BUCKETS = 10_000
LENGTHS = 3
SEED = 42
MIN_WORDS = 20
DRAW_PERCENT = 5
# The driver sorts MAX_RUNS * MAX_SEGMENTS keys of 16 bytes at most.
MAX_RUNS = 2048
MAX_SEGMENTS = 1024
KNOWN_WORDS = 1_000_000

# Bytes of a word: digits, letters (A to Z as a to z), and all of U+0080 and more.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def _advance() -> np.ndarray:
    """[k, i, v]: the CRC-32 register that has byte i equal to ``v`` and else zeros,
    after 2**k zero bytes. The register is linear, so the four bytes combine."""
    once = np.empty((4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    low = values.copy()
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(0xEDB88320), low >> 1)
    once[0] = low
    for i in (1, 2, 3):
        once[i] = values << np.uint32(8 * (i - 1))
    levels = [once]
    for _ in range(31):
        levels.append(_apply(levels[-1], levels[-1]))
    return np.stack(levels)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]
    )


class Crc:
    """CRC-32 of joined byte strings, from those of the parts."""

    SHORT = 64

    def __init__(self) -> None:
        self.powers = _advance()
        unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        tables = [unit]
        for _ in range(self.SHORT - 1):
            tables.append(_apply(self.powers[0], tables[-1]))
        self.short = np.stack(tables).reshape(self.SHORT, 4 * 256)

    def shift(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``crc`` with ``length`` zero bytes behind it."""
        at = np.minimum(length, self.SHORT - 1) * 1024
        flat = self.short.reshape(-1)
        out = flat[at + (crc & 0xFF)]
        out ^= flat[at + 256 + ((crc >> 8) & 0xFF)]
        out ^= flat[at + 512 + ((crc >> 16) & 0xFF)]
        out ^= flat[at + 768 + (crc >> 24)]
        long = np.flatnonzero(length >= self.SHORT)
        if len(long):
            value, left = crc[long], length[long]
            for k in range(int(left.max()).bit_length()):
                value = np.where(left >> k & 1, _apply(self.powers[k], value), value)
            out[long] = value
        return out

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of first + second, where second has ``length`` bytes."""
        return self.shift(first, length) ^ second


class _Known(dict):
    """From word to its CRC and, from bit 32, its length."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | len(word) << 32
        self[word] = value
        return value


class Features:
    """Buckets of the word n-grams of texts, in one task."""

    def __init__(self, lengths: int = LENGTHS, buckets: int = BUCKETS) -> None:
        self.lengths, self.buckets = lengths, buckets
        self.crc, self.known = Crc(), _Known()
        self.space = np.uint32(zlib.crc32(b" "))

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words per text, and for every n-gram length the buckets and the texts."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        words = [t.encode().translate(_FOLD).split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = int(counts.sum())
        packed = np.fromiter(
            (v for own in words for v in map(self.known.__getitem__, own)), np.int64, total
        )
        doc = np.repeat(np.arange(len(texts)), counts)
        length = packed >> 32
        single = (packed & 0xFFFFFFFF).astype(np.uint32)
        spaced = self.crc.joined(np.full(total, self.space), single, length)
        grams, run = [], single
        for k in range(self.lengths):
            if k:
                run = self.crc.joined(run[:-1], spaced[k:], length[k:] + 1)
            # Runs must not cross texts; the CRCs of those that do are not used.
            inside = doc[k:] == doc[: total - k] if k else slice(None)
            grams.append(((run % np.uint32(self.buckets))[inside], doc[k:][inside]))
        return counts, grams


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        at = 0
        for _, texts in in_chunks([None] * batch.num_rows, batch.column(column).to_pylist()):
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def bucket_counts(texts: DataFrame, lengths: int = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all n-grams of ``text``: a task adds up its own rows, so at
    most one row per bucket and task is shuffled. Empty buckets have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, have = Features(lengths, buckets), np.zeros(buckets, np.int64)
        for _, part in _chunks(batches, "text"):
            for found, _ in features.of(part)[1]:
                have += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(have[used])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, lengths: int = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: how much likelier it is among the n-grams of
    ``target`` than of ``docs``, with one of each bucket added, as thousandths of a
    natural logarithm, rounded down."""
    spark = docs.sparkSession
    have = bucket_counts(docs, lengths, buckets).withColumnRenamed("n", "s")
    want = bucket_counts(target, lengths, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = both.join(have, "bucket", "left").join(want, "bucket", "left").fillna(0)
    both = saved(both, "buckets")
    all_s, all_t = (float(x) + buckets for x in both.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * F.lit(all_s) / ((s + 1.0) * F.lit(all_t))
    return both.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, gains: np.ndarray, lengths: int = LENGTHS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row. ``gains`` has one number
    per bucket, so what tasks receive does not grow with the corpus."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lengths, len(gains))
        for rows, texts in _chunks(batches, "text"):
            counts, grams = features.of(texts)
            number, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for found, doc in grams:
                number += np.bincount(doc, minlength=len(texts))
                upto = np.concatenate(([0], np.cumsum(gains[found])))
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                weight += upto[ends[1:]] - upto[ends[:-1]]
            columns = [rows.column("doc_id"), *(pa.array(x) for x in (counts, number, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def gumbel(id_column: str = "doc_id", seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that depends on the seed and the id alone."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share))).cast("bigint")


def _order() -> tuple[Column, ...]:
    """High scores first, then small ids; the number of n-grams settles repeated ids."""
    return F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")


def _splitters(runs: DataFrame, n_runs: int) -> list[tuple]:
    """Keys (-score, id is null, id, n_features) between the segments, in order.

    Every sorted run gives as many evenly spaced keys as there are segments; of
    all of them, sorted, every one at a multiple of the number of runs is taken.
    """
    segments = min(n_runs, MAX_SEGMENTS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.select(["score", "doc_id", "n_features"]) for b in batches]
        if rows:
            table = pa.Table.from_batches(rows)
            at = np.unique(np.arange(segments) * table.num_rows // segments)
            yield from table.take(pa.array(at)).to_batches()

    kind = runs.schema["doc_id"].dataType.simpleString()
    keys = runs.select("score", "doc_id", "n_features").mapInArrow(
        sample, f"score bigint, doc_id {kind}, n_features bigint"
    )
    found = sorted((-r[0], r[1] is None, r[1] if r[1] is not None else 0, r[2]) for r in keys.collect())
    step = max(1, len(found) // segments)
    return found[step::step][: segments - 1]


def ranked(scored: DataFrame, drawn: Column, percent: int = DRAW_PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3… over the ``percent`` of the rows for which
    ``drawn`` holds that have the highest ``score`` (ties: smaller ``doc_id``, null
    last, then fewer ``n_features``), rounded down; null for all others.

    ``scored`` is read several times and should be a written table. A run is a
    task's rows, sorted there. Runs and segments are bounded, so the driver holds at
    most 2,048 * 1,024 keys and one count per segment. Only rows of segments that
    begin within the draw are shuffled, to the segment that they belong to: about
    ``percent`` of all. Equal scores are split by id, so no score fills a segment.
    """
    taken = scored.where(drawn)
    if taken.rdd.getNumPartitions() > MAX_RUNS:
        taken = taken.coalesce(MAX_RUNS)
    runs = taken.sortWithinPartitions(*_order())
    cuts = _splitters(runs, max(1, taken.rdd.getNumPartitions()))
    names = [*scored.columns, "segment"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            score, name, size = (batch.column(c).to_pylist() for c in ("score", "doc_id", "n_features"))
            segment = [
                bisect_right(cuts, (-a, b is None, b if b is not None else 0, c))
                for a, b, c in zip(score, name, size, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment, pa.int32())], names=names)

    dealt = saved(taken.mapInArrow(cut, f"{schema}, segment int"), "segments")
    sizes = {r["segment"]: r["count"] for r in dealt.groupBy("segment").count().collect()}
    draw = percent * sum(sizes.values()) // 100
    begins, before = [], 0
    for k in range(len(cuts) + 1):
        begins.append(before)
        before += sizes.get(k, 0)
    reached = sum(1 for b in begins if b < draw)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        for batch in batches:
            ranks = []
            for k in batch.column("segment").to_pylist():
                place[k] = place.get(k, begins[k]) + 1
                ranks.append(place[k] if place[k] <= draw else None)
            columns = [*batch.columns[:-1], pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:-1], "rank"])

    none = F.lit(None).cast("bigint").alias("rank")
    rest = scored.where(~F.coalesce(drawn, F.lit(False))).select("*", none)
    rest = rest.unionByName(dealt.where(F.col("segment") >= reached).select(*scored.columns, none))
    if not reached:
        return rest
    moved = dealt.where(F.col("segment") < reached).repartitionById(reached, F.col("segment"))
    merged = moved.sortWithinPartitions(F.asc("segment"), *_order()).mapInArrow(number, f"{schema}, rank bigint")
    return merged.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Whole texts; A to Z count as a to z, words are runs of digits, letters and
    characters from U+0080 on. ``weight`` sums the gains of all n-grams of one to
    three words, ``score`` adds the noise of the id, ``rank`` numbers the drawn
    rows: ``percent`` of those with at least ``min_words`` words. Null and empty
    texts have no n-grams and weight 0. Rows without an id share one noise and lose
    ties; repeated rows are ranked one after the other. Without documents there are
    no rows, without target texts every bucket counts as unseen there. Only
    ``doc_id`` and ``text`` of the documents and ``text`` of the target are read.
    """
    gains = np.zeros(BUCKETS, np.int64)
    for row in bucket_gains(docs, target).collect():  # BUCKETS rows at any size
        gains[row["bucket"]] = row["gain"]
    weighed = weigh(docs, gains).withColumn("score", F.col("weight") + gumbel())
    return ranked(saved(weighed, "weighed"), F.col("n_words") >= min_words, percent)
