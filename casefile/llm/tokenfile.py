"""Files of token ids, compressed by a grammar per shard of documents.

Documents are put in the order of their id by a range exchange. A task encodes
its range, in shards of bounded length, and compresses each with Re-Pair; a shard
is one row of the written table: its document ids, and the rules, expansion lengths
and symbols as bytes. A small second table has the number of ids before each range.
Spark writes both, so a lost task leaves nothing behind, and any store will do.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from itertools import compress as compress_by

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm.chunks import in_chunks
from casefile.llm.repair import Grammar, compress

END_ID = 2
SHARD_IDS = 1_000_000
KNOWN_WORDS = 800_000
BLANKS = " \t\n\v\f\r"
# ASCII marks but the apostrophe, which can begin a word of letters.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
# A chunk of texts has its distinct words looked up once.
CHUNK_CHARS = 4_000_000
# Rows of an Arrow batch that are Python objects at the same time.
ROWS_AT_ONCE = 4_000


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_wise(tokenizer) -> bool:
    """Whether texts may be cut at blanks (space, U+0009 to U+000D) before encoding.

    So it is if blanks are removed before the model sees a text, and nothing looks
    across them: the normalizers work on characters and lower them (no Unicode form
    composes or reorders across a blank), the first step keeps only what its pattern matches,
    no match of it holds a blank, and no added token does or takes one along; added
    tokens can be told by ``<|``.
    """
    spec = json.loads(tokenizer.to_str())

    def steps(part: dict | None, key: str) -> list[dict]:
        return [] if part is None else part[key] if part["type"] == "Sequence" else [part]

    normal = steps(spec["normalizer"], "normalizers")
    cuts = steps(spec["pre_tokenizer"], "pretokenizers")
    if any(s["type"] not in ("NFC", "Lowercase") and not _blanks_only(s) for s in normal) or not cuts:
        return False
    if cuts[0]["type"] != "Split" or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"]:
        return False
    if any(set(BLANKS) & set(t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return False
    if spec["post_processor"] is not None or spec["truncation"] is not None or spec["padding"] is not None:
        return False
    if any("<|" not in t["content"] for t in spec["added_tokens"]) or not {"type": "Lowercase"} in normal:
        return False
    probes = ["".join(f"{a}{blank}" for a in ("a", "1", "'", "é", ".")) for blank in BLANKS]
    alone = [[w for word in p.split() for w in tokenizer.encode(word, add_special_tokens=False).ids] for p in probes]
    return alone == [tokenizer.encode(p, add_special_tokens=False).ids for p in probes]


def _blanks_only(step: dict) -> bool:
    return step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "


def _words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts cut at blanks, with A to Z lowered unless they may hold an added token:
    the number of each word, in order, the distinct words, and by text the words
    before it, with the whole number at the end. An empty word may be among them."""
    whole = pa.array(texts, pa.large_string())
    lowered, special = pc.ascii_lower(whole), pc.match_substring(whole, "<|")
    if pc.any(special).as_py():
        lowered = pc.if_else(special, whole, lowered)
    cut = pc.ascii_split_whitespace(lowered)
    coded = cut.flatten().dictionary_encode()
    # Not to_pylist(), which makes a scalar of every word first.
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return coded.indices.to_numpy(), distinct, cut.offsets.to_numpy()


class Letters:
    """Words of small Latin letters, many in one call.

    Such a word is in normal form already and is one word to the tokenizer, so only
    the byte alphabet and the model are left of it: words go to the model side by
    side, and the ids that end a word tell them apart.
    """

    LETTERS = "[a-zß-öø-ÿ]+"
    SMALL = re.compile(LETTERS)
    BEFORE_MARKS = re.compile("[0-9a-zA-ZÀ-ÖØ-öø-ÿ]")
    LOWER = {c: c + 32 for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x100) if self.SMALL.fullmatch(chr(c))]
        stands = {c: bytes_of.pre_tokenize_str(c)[0][0] for c in letters}
        # One letter after the other is replaced, so none may stand for another's byte.
        self.alphabet = {c: s for c, s in stands.items() if c != s}
        apart = not set(self.alphabet) & set("".join(stands.values()))
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = tokenizer.model.end_of_word_suffix, tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if suffix and word.endswith(suffix)]] = True
        probes = [*letters, "".join(letters), *(a + b for a, b in pairwise(letters))]
        self.usable = apart and self.ids(probes) == _packed(tokenizer, probes)

    @classmethod
    def small(cls, words: list[str]) -> list[bool]:
        """Of each word, whether it is of small Latin letters alone."""
        return pc.match_substring_regex(pa.array(words, pa.large_string()), f"^{cls.LETTERS}$").to_numpy(False).tolist()

    def ids(self, words: list[str]) -> list[bytes] | None:
        """Ids of each word; None if the model does not end every word by an id."""
        text = " ".join(words)
        for letter, stands in self.alphabet.items():
            text = text.replace(letter, stands)
        found = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[found]) + 1) * 4
        if len(ends) != len(words) or (len(ends) and ends[-1] != found.nbytes):
            return None
        packed = found.tobytes()
        return [packed[a:b] for a, b in pairwise([0, *ends.tolist()])]


def _packed(tokenizer, texts: list[str]) -> list[bytes]:
    found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * 4
    packed = np.fromiter(chain.from_iterable(found), "<u4", int(ends[-1]) // 4 if found else 0).tobytes()
    return [packed[a:b] for a, b in pairwise([0, *ends.tolist()])]


class Encoder:
    """Ids of texts, in one task. Where texts may be cut at blanks, every distinct
    word is encoded once; the table of words is bounded, a full one starts anew."""

    def __init__(self, tokenizer, limit: int = KNOWN_WORDS):
        self.tokenizer, self.limit = tokenizer, limit
        self.words: dict[str, bytes] | None = {} if word_wise(tokenizer) else None
        self.letters = None if self.words is None else Letters(tokenizer)
        probes = [*MARKS, *(c + m for c in "a1éß" for m in (*MARKS, MARKS)), "É", "ÀÞ", MARKS]
        self.by_marks = True
        self.by_marks = self.words is not None and _packed(tokenizer, probes) == [
            b"".join(_packed(tokenizer, list(self._parts(p)))) for p in probes
        ]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, those of plain letters by the model alone."""
        if not self.letters.usable:
            return _packed(self.tokenizer, words)
        plain = Letters.small(words)
        small = self.letters.ids(list(compress_by(words, plain))) if any(plain) else []
        if small is None:
            return _packed(self.tokenizer, words)
        fast, slow = iter(small), iter(_packed(self.tokenizer, [w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(fast) if p else next(slow) for p in plain]

    def _parts(self, word: str) -> tuple[str, str]:
        """A word as two that the tokenizer takes apart anyway: marks after a Latin
        letter or digit are a word of their own to it; there may be none. Letters are
        lowered where that leaves plain ones."""
        if not self.by_marks or "<|" in word:
            return word, ""
        stem = word.rstrip(MARKS)
        if not Letters.BEFORE_MARKS.fullmatch(stem[-1:]):
            stem = word
        marks = word[len(stem) :]
        if not stem.isascii() and not Letters.SMALL.fullmatch(stem):
            low = stem.translate(Letters.LOWER)
            stem = low if Letters.SMALL.fullmatch(low) else stem
        return stem, marks

    def _learn(self, fresh: list[str]) -> None:
        """Adds words to the table; those with parts are put together from them."""
        known, stems, tails = self.words, [], []
        plain = Letters.small(fresh)
        odd = [word for word, small in zip(fresh, plain, strict=True) if not small]
        for word in odd:
            stem, marks = self._parts(word)
            stems.append(stem)
            tails.append(marks)
        parts = [p for p in {*compress_by(fresh, plain), *stems, *tails} if p not in known]
        known.update(zip(parts, self._ids(parts), strict=True))
        for word, stem, marks in zip(odd, stems, tails, strict=True):
            known[word] = known[stem] + known[marks]

    def apply(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text: the ids of the distinct words of
        all texts side by side, picked out word by word."""
        if self.words is None:
            return _packed(self.tokenizer, texts)
        at, distinct, before = _words(texts)
        known = list(map(self.words.get, distinct))
        fresh = [w for w, ids in zip(distinct, known, strict=True) if ids is None]
        if fresh:
            if len(self.words) + len(fresh) > self.limit:
                self.words.clear()
                fresh = distinct
            self._learn(fresh)
            known = list(map(self.words.get, distinct))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(size) - size
        counts = size[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        # Where each id lies among those of the distinct words.
        place = np.repeat(start[at] - ends[:-1], counts) + np.arange(ends[-1])
        packed = np.frombuffer(b"".join(known), "<u4")[place].tobytes()
        return [packed[4 * a : 4 * b] for a, b in pairwise(ends[before].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker: its table of words serves all of its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_tokenizer(path))
    return _ENCODERS[path]


SHARD = "part int, shard int, first_token bigint, n_tokens bigint, doc_ids array<{kind}>, grammar binary"


def shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The rows of the file: ``part`` is the range of ids, ``shard`` and
    ``first_token`` the shard's number and the ids before it in that range."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer_path), np.array([end_id], "<u4").tobytes()
        base = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        names: list = []
        coded: list[bytes] = []
        held, shard, first = 0, 0, 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded)))
            ids = np.frombuffer(b"".join(coded), "<u4")
            grammar = compress(ids, ends, max(base, int(ids.max()) + 1)).to_bytes()
            row = [[part], [shard], [first], [len(ids)], [pa.array(names, id_type)], [grammar]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary())
            columns = [pa.array([r[0].to_pylist()] if k == 4 else r, t) for k, (r, t) in enumerate(zip(row, types, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "first_token", "n_tokens", "doc_ids", "grammar"])

        part = TaskContext.get().partitionId()
        slices = (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        for batch in slices:
            id_type = batch.schema.field("doc_id").type
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            own, texts = (list(x) for x in zip(*rows, strict=True))
            for some, whole in in_chunks(own, texts, CHUNK_CHARS):
                for name, ids in zip(some, encoder.apply(whole), strict=True):
                    names.append(name)
                    coded.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= shard_ids:
                        yield close()
                        shard, first = shard + 1, first + held
                        names, coded, held = [], [], 0
                        pa.default_memory_pool().release_unused()
        if names:
            yield close()

    # Equal ids are told apart by their texts, so that one id can fill many ranges.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(pack, SHARD.format(kind=kind))


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> None:
    """Encodes whole texts with the tokenizer, without special tokens, ends each
    with ``end_id``, and writes them in ascending order of ``doc_id`` (null first;
    repeated ids in an order of their texts) to ``folder``, which must be new.

    Null and empty texts have the end id alone. A shard closes after the document
    that takes it to ``shard_ids``, so memory grows with a shard and with the longest
    text. The driver gets one count per range. ``tokenizer_path`` must exist on every
    machine.
    """
    spark = docs.sparkSession
    shards(docs, tokenizer_path, end_id, shard_ids).write.parquet(f"{folder}/shards")
    sizes = spark.read.parquet(f"{folder}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    rows, before = [], 0
    for part, n in sorted(tuple(r) for r in sizes.collect()):
        rows.append((part, before, n))
        before += n
    ranges = spark.createDataFrame(rows, "part int, range_start bigint, range_tokens bigint")
    ranges.coalesce(1).write.parquet(f"{folder}/ranges")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    ranges = spark.read.parquet(f"{folder}/ranges").select("part", "range_start")
    found = spark.read.parquet(f"{folder}/shards").join(ranges, "part")
    return found.withColumn("first_token", F.col("first_token") + F.col("range_start"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in ``folder``: the number of
    ids before it, its own number with the end id, and its ids, as little-endian
    32-bit integers."""
    rows = _located(spark, folder)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch.column("doc_ids").slice(k, 1).flatten()
                grammar = Grammar.from_bytes(batch.column("grammar")[k].as_py())
                ids = grammar.whole().astype("<u4", copy=False)
                ends = grammar.token_ends.astype(np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                start = begins + batch.column("first_token")[k].as_py()
                offsets = pa.py_buffer(np.concatenate((begins, ends[-1:])).astype(np.int64) * 4)
                packed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(ids)])
                columns = [names, pa.array(start), pa.array(ends - begins), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    chosen = rows.select("first_token", "doc_ids", "grammar")
    return chosen.mapInArrow(unpack, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def read_range(spark: SparkSession, folder: str, first: int, count: int) -> DataFrame:
    """(start, ids array<bigint>) of the ids ``first`` to ``first + count`` of the whole
    sequence, one row per shard that holds some. Only those shards are read, and of
    their grammars only symbols that reach into the range are opened."""
    rows = _located(spark, folder).where(
        (F.col("first_token") < first + count) & (F.col("first_token") + F.col("n_tokens") > first)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, found = [], []
            for begin, data in zip(*(batch.column(c).to_pylist() for c in ("first_token", "grammar")), strict=True):
                grammar = Grammar.from_bytes(data)
                starts.append(max(first, begin))
                found.append(grammar.expand(grammar.symbols, starts[-1] - begin, first + count - begin).tolist())
            columns = [pa.array(starts, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["start", "ids"])

    return rows.select("first_token", "grammar").mapInArrow(cut, "start bigint, ids array<bigint>")
