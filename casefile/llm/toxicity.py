"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two strings sums, over every subsequence of four symbols found in
both within six places, the product of their weights; every place skipped halves
a weight. So an insult with letters put in or left out is still near the plain
one. Case, accents, digits and punctuation are taken off first, white space is a
symbol, and a string is a word with the white space around it. Letters from
U+0250 on are one symbol: words of other scripts than Latin differ by length only.

Landmark strings approximate the kernel (Nyström): the machine is linear in the
whitened kernel values to the landmarks. Because the kernel is a sum over
subsequences, its decision value is one too, so a fitted model is a table of
weights by subsequence and a text is scored by looking up its own.

A document has the value of its worst word: training knows only which documents
are toxic, so the machine learns from the worst word of each (a multiple-instance
machine), round after round.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.chunks import in_chunks
from casefile.llm.labelled import class_weights, in_order, sample

GAP, MARK, OTHER, SPACE = 0, 29, 30, 31
SPAN, DECAY = 6, 0.5
OFFSETS = list(combinations(range(1, SPAN), 3))
PER_CLASS = 1_500
LANDMARKS = 64
NEAR = 1.0


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point below U+0250, and whether it bears a mark; the
    last entry is for the rest."""
    table, marked = np.zeros(0x251, np.uint8), np.zeros(0x251, np.int64)
    for point in range(0x250):
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        base = parts[0].lower()
        if char.isspace():
            table[point] = SPACE
        elif "a" <= base <= "z":
            table[point] = ord(base) - 96
            marked[point] = len(parts) > 1
        elif char.isalpha():
            table[point] = OTHER
    table[0x250] = OTHER
    return table, marked


ALPHABET, MARKED = _alphabet()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, with one SPACE at the start of every word and
    at the end, and the text of each symbol. Texts without letters have none.
    An accent is a symbol after its letter."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts) + 1), np.concatenate((lengths, [len(codes) - lengths.sum()])))
    codes = np.minimum(codes, 0x250)
    mapped = ALPHABET[codes]
    kept = np.flatnonzero(mapped != GAP)
    mapped, doc, mark = mapped[kept], doc[kept], MARKED[codes[kept]]
    space = mapped == SPACE
    single = np.concatenate((~(space[:-1] & space[1:]), [True]))
    mapped, doc, mark = mapped[single], doc[single], mark[single]
    place = np.arange(len(mapped)) + np.cumsum(mark) - mark
    out = np.full(len(mapped) + mark.sum(), MARK, np.uint8)
    out[place] = mapped
    return out, np.minimum(np.repeat(doc, 1 + mark), len(texts) - 1)


def word_starts(stream: np.ndarray) -> np.ndarray:
    return np.flatnonzero(stream == SPACE)[:-1]


def subsequences(stream: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each choice of places, the subsequence that starts at every place, as
    a number, and its weight. Places after the end are gaps."""
    padded = np.concatenate((stream, np.zeros(SPAN, np.uint8))).astype(np.int32)
    n = len(stream)
    shifted = [padded[k : k + n] << (5 * (3 - p)) for p in range(4) for k in range(SPAN)]
    for a, b, c in OFFSETS:
        number = shifted[0] + shifted[SPAN + a] + shifted[2 * SPAN + b] + shifted[3 * SPAN + c]
        yield number, DECAY ** (c - 3)


def _whole(number: np.ndarray) -> np.ndarray:
    """Whether a subsequence has no gap."""
    parts = [(number >> s) & 31 for s in (15, 10, 5, 0)]
    return (parts[0] > 0) & (parts[1] > 0) & (parts[2] > 0) & (parts[3] > 0)


@dataclass
class Model:
    weights: np.ndarray  # by subsequence
    bias: float
    slope: float
    shift: float

    def values(self, texts: list[str]) -> np.ndarray:
        """The decision value of each text's worst word; ``bias`` without words."""
        stream, doc = symbols(texts)
        starts = word_starts(stream)
        best = np.full(len(texts), 0.0)
        if len(starts):
            total = np.zeros(len(stream), np.float32)
            for number, weight in subsequences(stream):
                total += self.weights[number] * np.float32(weight)
            per_word = np.add.reduceat(total, starts)
            per_word[-1] -= total[-1]  # the closing space starts no word
            owner = doc[starts + 1]
            np.maximum.at(best, owner, per_word)
        return best + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        value = np.clip(self.slope * self.values(texts) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-value))


def _profile(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of distinct words, sorted."""
    stream = np.frombuffer(b"".join(bytes([SPACE]) + w for w in words) + bytes([SPACE]), np.uint8)
    starts = np.flatnonzero(stream == SPACE)[:-1]
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(stream) - 1)))
    keys, weights = [], []
    for number, weight in subsequences(stream):
        number, inner = number[:-1], (number[:-1] >> 10) & 31
        third = (number >> 5) & 31
        kept = _whole(number) & (inner != SPACE) & (third != SPACE)
        keys.append(owner[kept] * (1 << 20) + number[kept])
        weights.append(np.full(kept.sum(), weight))
    key, index = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(index, np.concatenate(weights), minlength=len(key))
    return key >> 20, key & ((1 << 20) - 1), weight


def _features(words: list[bytes], landmarks: np.ndarray, lookup: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values of words and (normalized) landmarks, of the words alone that
    are near one of the first ``near`` landmarks; and which those are."""
    found, places = [np.zeros((0, landmarks.shape[1]), np.float32)], []
    for at in range(0, len(words), 1000):
        part = words[at : at + 1000]
        owner, number, weight = _profile(part)
        known = lookup[number]
        hit = np.flatnonzero(known >= 0)
        rows = landmarks[known[hit]] * weight[hit, None].astype(np.float32)
        firsts = np.flatnonzero(np.diff(owner[hit], prepend=-1))
        if len(firsts):
            sums = np.add.reduceat(rows, firsts, axis=0)
            kept = sums[:, :near].max(axis=1) >= NEAR
            found.append(sums[kept])
            places.append(at + owner[hit][firsts][kept])
    is_near = np.zeros(len(words), bool)
    if places:
        is_near[np.concatenate(places)] = True
    return np.vstack(found), is_near


def fit(
    rows: list[tuple[str, int]],
    n_landmarks: int = LANDMARKS,
    rounds: int = 1000,
    class_weight: tuple[float, float] = (1.0, 1.0),
) -> Model:
    """The model of labelled texts. Without both labels it finds nothing toxic.
    ``class_weight``: how many texts a row of label 0 and of label 1 stands for."""
    labels = np.array([y for _, y in rows], np.int64)
    nothing = Model(np.zeros(1 << 20, np.float32), -1.0, 1.0, -2.0)
    if not len(rows) or labels.min() == labels.max():
        return nothing
    index: dict[bytes, int] = {}
    bags = []
    for text, _ in rows:
        stream, _ = symbols([text])
        own = {w for w in stream.tobytes().split(bytes([SPACE])) if len(w) > 1}
        bags.append(np.array([index.setdefault(w, len(index)) for w in sorted(own)], np.int64))
    if not index:
        return nothing
    words = list(index)
    member = np.concatenate(bags)
    sizes = np.array([len(b) for b in bags])
    bag_of = np.repeat(np.arange(len(bags)), sizes)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    in1 = np.bincount(member[labels[bag_of] == 1], minlength=len(words))
    in0 = np.bincount(member[labels[bag_of] == 0], minlength=len(words))
    share = (in1 + in0 + 1) / (len(rows) + 2)
    surprise = (in1 / n1 - in0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    order = np.lexsort((np.arange(len(words)), -surprise))
    chosen = list(order[: 3 * n_landmarks])
    taken = set(chosen)
    common = [i for i in np.lexsort((np.arange(len(words)), -in0)) if i not in taken]
    chosen += common[:n_landmarks]
    owner, number, weight = _profile([words[i] for i in chosen])
    used, column = np.unique(number, return_inverse=True)
    lookup = np.full(1 << 20, -1, np.int64)
    lookup[used] = np.arange(len(used))
    table = np.zeros((len(used), len(chosen)))
    table[column, owner] = weight
    table /= np.maximum(1e-9, np.sqrt((table**2).sum(axis=0)))
    kernel = table.T @ table
    value, vector = np.linalg.eigh(kernel)
    kept = value > 1e-6 * value.max()
    whiten = (vector[:, kept] / np.sqrt(value[kept])) @ vector[:, kept].T
    # Words far from every landmark have a value near 0, which a bag always has.
    features, near = _features(words, table.astype(np.float32), lookup, 3 * n_landmarks)
    place = np.cumsum(near) - 1
    sizes = np.bincount(bag_of[near[member]], minlength=len(bags))
    member = place[member[near[member]]]
    features = features @ whiten.astype(np.float32)
    theta, bias = _machine(features, member, sizes, labels, rounds)
    weights = np.zeros(1 << 20, np.float32)
    weights[used] = table @ (whiten @ theta)
    model = Model(weights, bias, 1.0, 0.0)
    values = np.concatenate([model.values([t]) for t, _ in rows])
    _calibrate(model, values, labels, np.array(class_weight)[labels])
    return model


def _machine(features, member, sizes, labels, rounds) -> tuple[np.ndarray, float]:
    """Hinge loss of every bag's best member, by averaged gradient steps."""
    # A bag may have no near word: it then has value 0.
    member = np.concatenate((member, np.full(len(sizes), len(features))))
    bag = np.concatenate((np.repeat(np.arange(len(sizes)), sizes), np.arange(len(sizes))))
    member, sizes = member[np.argsort(bag, kind="stable")], sizes + 1
    features = np.vstack((features, np.zeros((1, features.shape[1]), np.float32)))
    filled = np.arange(len(sizes))
    starts = np.cumsum(sizes) - sizes
    sign = np.where(labels[filled] == 1, 1.0, -1.0)
    balance = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    theta, bias = np.zeros(features.shape[1]), -0.5
    moment, square = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    # The first worst words are those nearest to what only toxic texts have.
    mean = np.zeros(features.shape[0])
    np.add.at(mean, member, np.repeat(np.where(labels == 1, 1 / (labels == 1).sum(), -1 / (labels == 0).sum()), sizes))
    theta = (features.T @ mean.astype(np.float32)).astype(float)
    theta /= max(1e-9, np.abs(features @ theta).max())
    kept, n_kept = np.zeros(len(theta) + 1), 0
    owner = np.repeat(np.arange(len(filled)), sizes[filled])
    for step in range(1, rounds + 1):
        value = np.maximum(features @ theta.astype(np.float32), 0)[member]
        best = np.maximum.reduceat(value, starts)
        first = np.full(len(filled), -1)
        top = np.flatnonzero(value == best[owner])[::-1]
        first[owner[top]] = top
        wrong = sign * (best + bias) < 1
        pull = np.where(wrong, -sign * balance, 0.0)
        live = wrong & (best > 0)
        grad = features[member[first[live]]].T @ pull[live] + 1e-4 * theta
        grad = np.append(grad, pull.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        rate = 0.05 / (1 + step / 100)
        theta, bias = theta - rate * move[:-1], bias - rate * move[-1]
        if step > rounds // 2:
            kept, n_kept = kept + np.append(theta, bias), n_kept + 1
    kept /= n_kept
    return kept[:-1], float(kept[-1])


def _calibrate(model: Model, values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Scores reach 0.7 where training texts are told apart best (by F1), half
    way to the value below; the slope comes from the spread of the values. Texts
    count by their weights, so neither depends on how the labels were sampled."""
    order = np.argsort(-values, kind="stable")
    hits = np.cumsum((weights * labels)[order])
    f1 = 2 * hits / (np.cumsum(weights[order]) + (weights * labels).sum())
    last = np.concatenate((np.diff(values[order]) != 0, [True]))
    best = int(np.argmax(np.where(last, f1, -1)))
    here = values[order][best]
    below = values[order][best + 1] if best + 1 < len(order) else here - 1
    spread = np.sqrt(np.average((values - np.average(values, weights=weights)) ** 2, weights=weights))
    model.slope = float(2 / max(1e-3, spread))
    model.shift = float(np.log(0.7 / 0.3) - model.slope * (here + below) / 2)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` documents of each label (see ``sample``), in
    one task of its own: the texts do not pass through the driver. The cut is
    placed at the label shares of all training labels, not of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = fit(in_order(rows), class_weight=class_weights(rows))
        used = np.flatnonzero(model.weights).astype(np.int32)
        columns = [used.tobytes(), model.weights[used].tobytes(), model.bias, model.slope, model.shift]
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["at", "weights", "bias", "slope", "shift"])

    rows = sample(docs, labels, "toxic", per_class).repartition(1)
    schema = "at binary, weights binary, bias double, slope double, shift double"
    fitted = rows.mapInArrow(run, schema).first()
    if fitted is None:
        return fit([])
    weights = np.zeros(1 << 20, np.float32)
    weights[np.frombuffer(fitted["at"], np.int32)] = np.frombuffer(fitted["weights"], np.float32)
    return Model(weights, fitted["bias"], fitted["slope"], fitted["shift"])


def score(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """Adds ``toxicity`` (0 to 1) and ``is_toxic`` (score at least ``cut``) to
    every row; columns of these names are replaced.

    Whole texts, one narrow pass; the model, 4 MB at any size, is broadcast.
    Null, empty and letterless texts get the lowest score. Repeats stay.
    """
    kept = [c for c in docs.columns if c not in ("toxicity", "is_toxic")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            at = 0
            for _, texts in in_chunks([None] * batch.num_rows, batch.column(len(kept)).to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(fitted.scores(texts), pa.float64())], names=[*kept, "toxicity"]
                )

    scored = docs.select(*kept, F.col("text").alias("__text")).mapInArrow(run, schema + ", toxicity double")
    return scored.withColumn("is_toxic", F.col("toxicity") >= cut)

