"""Quality scores by Bradley-Terry ranking of documents.

A labelled pair says that one document is preferred over another. The chance of
that is the logistic function of the difference of their scores, and a score is
linear in features of the text, so the weights come from logistic regression on
feature differences. A quantile of the training scores is the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from casefile.llm.chunks import in_chunks, shingle_hashes, word_hashes, words_of
from casefile.llm.graph import saved
from casefile.llm.labelled import held_out

PAIRS = 60_000
PENALTY = 1e-3
SLOPES = np.geomspace(0.05, 20, 60)
# Documents of a label are numbered by cells of their hash.
CELL_BITS = 8
SYMBOLS = np.array(sorted(map(ord, "#*$%&|<>")), np.uint32)
STOPS = np.array(sorted(map(ord, ".,;:?")), np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """One row per text: shares and logarithms of counts, all finite."""
    words = words_of(texts)
    codes = words.codes
    chars = np.maximum(1, np.diff(words.text_start) - 1)
    counts = words.counts()
    some = np.maximum(1, counts)
    lengths = words.end - words.start
    hashes = word_hashes(words)

    def share(mask: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return words.per_doc(mask) / whole

    def distinct(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(values[order]) != 0) | (np.diff(doc[order]) != 0)
        return np.bincount(doc[order][new], minlength=words.n_docs)

    def by_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[mask], minlength=words.n_docs) / some

    shingles, shingle_doc = shingle_hashes(words, 3)
    n_shingles = np.maximum(1, np.bincount(shingle_doc, minlength=words.n_docs))
    same_next = np.zeros(len(hashes), bool)
    same_next[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    last = codes[words.end - 1] if len(hashes) else np.zeros(0, np.uint32)
    lead = codes[words.start] if len(hashes) else np.zeros(0, np.uint32)
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
    lines = words.per_doc(codes == 10)
    mean = np.bincount(words.doc, lengths, minlength=words.n_docs) / some
    columns = [
        np.log1p(counts),
        mean,
        np.sqrt(np.bincount(words.doc, lengths**2, minlength=words.n_docs) / some),
        share(upper, chars),
        share(np.isin(codes, SYMBOLS), chars),
        share(codes == ord("!"), chars),
        share(np.isin(codes, STOPS), chars),
        share((codes >= 48) & (codes <= 57), chars),
        distinct(hashes, words.doc) / some**0.8,
        distinct(shingles, shingle_doc) / n_shingles,
        by_word(same_next),
        by_word(np.isin(last, SYMBOLS)),
        by_word(lengths == 1),
        by_word((lead >= 65) & (lead <= 90)),
        lines / some,
    ]
    return np.column_stack(columns).astype(float)


@dataclass
class Ranking:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of feature rows."""
        return _expanded((rows - self.centre) / self.scale) @ self.weights

    def scores(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1; 0.5 at the threshold."""
        value = self.slope * (self.strengths(features(texts)) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(value, -40, 40)))


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack((z, np.abs(z), np.minimum(z**2, 9)))


def _pair_sums(gap: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, summed over the pairs."""
    chance = 1 / (1 + np.exp(-np.clip(gap @ weights, -40, 40)))
    return gap.T @ (chance - 1), (gap * (chance * (1 - chance))[:, None]).T @ gap


def _newton_step(slope: np.ndarray, bend: np.ndarray, weights: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    return np.linalg.solve(bend + penalty * np.eye(len(weights)), slope + penalty * weights)


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights that make ``better`` rows score above the ``worse`` ones: Newton
    steps on the mean logistic loss of the differences."""
    gap = better - worse
    weights = np.zeros(gap.shape[1])
    for _ in range(25):
        slope, bend = _pair_sums(gap, weights)
        step = _newton_step(slope / len(gap), bend / len(gap), weights, penalty)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(
    made: np.ndarray, labels: np.ndarray, weights: np.ndarray, pairs: int = PAIRS, quantile: float | None = None
) -> Ranking:
    """Ranks feature rows at hand (label 1 is preferred over 0), by ``pairs`` drawn pairs;
    ``train`` does it over tables.
    ``quantile`` of the training scores is the threshold; by default the share of
    label 0. Rows count by their weights in both and in the slope. Without both
    labels every text scores 0.5."""
    width = made.shape[1]
    if not len(made) or labels.min() == labels.max():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0, 1.0)
    centre, scale = made.mean(axis=0), np.maximum(1e-6, made.std(axis=0))
    model = Ranking(centre, scale, np.zeros(3 * width), 0.0, 1.0)
    wide = _expanded((made - centre) / scale)
    draw = np.random.default_rng(7)
    high = draw.choice(np.flatnonzero(labels == 1), pairs)
    low = draw.choice(np.flatnonzero(labels == 0), pairs)
    model.weights = fit_pairs(wide[high], wide[low])
    strengths = model.strengths(made)
    share = np.average(labels == 0, weights=weights) if quantile is None else quantile
    model.threshold = _quantile(strengths, weights, share)
    # The slope at which the scores, with that threshold, have the least log loss.
    gap = strengths - model.threshold
    losses = [np.average(np.logaddexp(0, np.where(labels == 1, -1, 1) * a * gap), weights=weights) for a in SLOPES]
    model.slope = float(SLOPES[int(np.argmin(losses))])
    return model


def _quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The quantile of weighted values, linear between them as numpy's is."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    # Each value is at the middle of its weight; the first is at 0, the last at 1.
    place = np.cumsum(weights) - weights / 2
    place = (place - place[0]) / max(1e-12, place[-1] - place[0])
    return float(np.interp(share, place, values))


def _sums(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over tasks of what ``parts`` makes of the features and labels of a batch.
    Spark adds the numbers up by place, so the driver gets one sum per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            labels = batch.column(0).to_numpy()
            if len(labels):
                made = batch.column(1).flatten().to_numpy().reshape(len(labels), -1)
                found = parts(made, labels)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "part"])

    by_place = rows.select("label", "features").mapInArrow(run, "place bigint, part double").groupBy("place").agg(F.sum("part").alias("total"))
    return np.array([r["total"] for r in sorted(by_place.collect(), key=lambda r: r["place"])])


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, features) of every labelled document that is not held out, written.
    Features are made where the texts lie; those of an id on several rows are the least."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("label"))
    schema = docs.select("doc_id").schema.add("features", ArrayType(DoubleType()))
    none = features([""])[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = np.vstack([none, *(features(part) for _, part in in_chunks(texts, texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(made), pa.list_(pa.float64()))], names=["doc_id", "features"])

    used = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out())
    made = used.mapInArrow(run, schema).join(known, "doc_id")
    return saved(made.groupBy("doc_id", "label").agg(F.min("features").alias("features")), "training")


def _pairs(rows: DataFrame, size: dict[int, int], rounds: int) -> DataFrame:
    """(label 1, features of the better and then of the worse document) of ``rounds`` pairs
    for each document of the more frequent label; the others are taken in turn, so
    every training document is in a pair. Within a label the order is by hash, and a
    round moves the worse ones on by one."""
    most = max(size.values())

    def placed(label: int) -> DataFrame:
        order = F.xxhash64("doc_id").alias("order")
        of_label = rows.where(F.col("label") == label).select("features", "doc_id", order)
        celled = of_label.withColumn("cell", F.shiftright("order", 64 - CELL_BITS))
        counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        before = (F.sum("n").over(W.orderBy("cell")) - F.col("n")).alias("before")
        within = F.row_number().over(W.partitionBy("cell").orderBy("order", "doc_id")) - 1
        numbered = celled.withColumn("within", within).join(F.broadcast(counts.select("cell", before)), "cell")
        turns = F.sequence(F.col("before") + F.col("within"), F.lit(most - 1).cast("bigint"), F.lit(size[label]).cast("bigint"))
        each = numbered.select(F.explode(turns).alias("turn"), F.col("features").alias(f"of{label}"))
        repeated = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
        moved = F.col("turn") + (F.col("round") if label == 0 else F.lit(0))
        return repeated.select("round", F.pmod(moved, F.lit(most)).alias("place"), f"of{label}")

    both = placed(1).join(placed(0), ["round", "place"])
    return saved(both.select(F.lit(1).cast("bigint").alias("label"), F.concat("of1", "of0").alias("features")), "pairs")


def _value_at(values: DataFrame, place: int) -> float:
    """The value at a place, from 0, of all values in order. Each round counts values
    by 1,024 parts of the range and goes on with the part that holds the place."""
    least, most = values.agg(F.min("v"), F.max("v")).first()
    while least < most:
        here = values.where(F.col("v").between(least, most))
        part = F.least(F.floor((F.col("v") - least) / (most - least) * 1024), F.lit(1023)).alias("part")
        counts = here.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        for found in counts.orderBy("part").collect():
            if place < found["n"]:
                least, most = found["least"], found["most"]
                break
            place -= found["n"]
    return float(least)


def train(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> Ranking:
    """Fits on all labelled documents that are not held out, each in at least one pair,
    with at least ``PAIRS`` pairs where there are so many. The threshold is the exact
    quantile of all their scores (see ``fit``), the slope the best over all of them.
    The driver gets sums by place and counts, no rows."""
    rows = _training_rows(docs, labels)
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = features([""]).shape[1]
    if len(size) < 2:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0, 1.0)
    total = size[0] + size[1]
    moments = _sums(rows, lambda made, _: np.concatenate((made.sum(axis=0), (made**2).sum(axis=0)))) / total
    centre = moments[:width]
    scale = np.maximum(1e-6, np.sqrt(np.maximum(0, moments[width:] - centre**2)))
    rounds = min(-(-PAIRS // max(size.values())), min(size.values()))
    pairs = _pairs(rows, size, rounds)
    n_pairs = rounds * max(size.values())
    weights = np.zeros(3 * width)

    def slope_and_bend(made: np.ndarray, _: np.ndarray) -> np.ndarray:
        better, worse = (_expanded((m - centre) / scale) for m in (made[:, :width], made[:, width:]))
        slope, bend = _pair_sums(better - worse, weights)
        return np.concatenate((slope, bend.ravel()))

    for _ in range(25):
        found = _sums(pairs, slope_and_bend) / n_pairs
        step = _newton_step(found[: len(weights)], found[len(weights) :].reshape(len(weights), -1), weights)
        weights = weights - step
        if np.abs(step).max() < 1e-7:
            break
    # Sums depend on the order of tasks in their last digits.
    model = Ranking(centre, scale, np.round(weights, 6), 0.0, 1.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(model.strengths(made))], names=["v"])

    values = saved(rows.select("features").mapInArrow(strengths, "v double"), "strengths")
    place = (size[0] / total if quantile is None else quantile) * (total - 1)
    low = _value_at(values, int(place))
    high = _value_at(values, min(int(place) + 1, total - 1))
    model.threshold = low + (high - low) * (place - int(place))

    def losses(made: np.ndarray, label: np.ndarray) -> np.ndarray:
        gap = np.where(label == 1, -1, 1) * (model.strengths(made) - model.threshold)
        return np.array([np.logaddexp(0, a * gap).sum() for a in SLOPES])

    model.slope = float(SLOPES[int(np.argmin(_sums(rows, losses)))])
    return model


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """Adds ``quality_score`` (0 to 1, higher is better) to every row; a column of
    that name is replaced.

    Whole texts, one narrow pass; null texts count as empty, and an empty text
    has a score like any other. Repeats stay.
    """
    kept = [c for c in docs.columns if c != "quality_score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in in_chunks([None] * batch.num_rows, batch.column(len(kept)).to_pylist()):
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))]
                at += len(texts)
                columns.append(pa.array(shared.value.scores(texts), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "quality_score"])

    return docs.select(*kept, F.col("text").alias("__text")).mapInArrow(run, schema + ", quality_score double")
