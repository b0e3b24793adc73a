"""Grammars and token files against the tokenizer library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casefile.llm import repair, tokenfile
from casefile.llm.queries import WORD_MODEL, op12_repair
from casefile.llm.repair import Grammar, compress
from tests.compare import TESTDATA

PATH = public_tokenizers.path(WORD_MODEL)


def grammar_of(documents: list[list[int]], base: int, least: int = 4) -> Grammar:
    ids = np.array([i for d in documents for i in d], np.uint32)
    ends = np.cumsum([len(d) for d in documents]).astype(np.int64)
    return Grammar.from_bytes(compress(ids, ends, base, least).to_bytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8), st.integers(2, 4), st.data())
def test_round_trip_and_random_access(documents, least, data):
    grammar = grammar_of(documents, 4, least)
    whole = [i for d in documents for i in d]
    assert grammar.expand(grammar.symbols).tolist() == whole
    assert grammar.whole().tolist() == whole
    for k, own in enumerate(documents):
        assert grammar.document(k).tolist() == own
        first = data.draw(st.integers(0, len(own)))
        last = data.draw(st.integers(first, len(own)))
        assert grammar.document(k, first, last).tolist() == own[first:last]
    first = data.draw(st.integers(0, len(whole)))
    assert grammar.expand(grammar.symbols, first, first + 7).tolist() == whole[first : first + 7]


def test_no_frequent_pair_is_left():
    """The grammar ends where a pair by pair one would: no pair of neighbours within
    a document can be replaced ``least`` times."""
    rng = random.Random(5)
    words = [[rng.randrange(50) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    documents = [[i for _ in range(rng.randint(0, 80)) for i in rng.choice(words)] for _ in range(30)]
    grammar = grammar_of(documents, 50)
    counts: dict[tuple[int, int], int] = {}
    begin = 0
    for end in grammar.symbol_ends.tolist():
        own = grammar.symbols[begin:end].tolist()
        at = 0
        while at + 1 < len(own):
            pair = (own[at], own[at + 1])
            counts[pair] = counts.get(pair, 0) + 1
            at += 1
        begin = end
    assert max(counts.values()) < 4
    assert len(grammar.symbols) + 2 * len(grammar.left) < sum(map(len, documents)) / 2
    sizes = [len(grammar.expand(np.array([50 + k], np.uint32))) for k in range(len(grammar.left))]
    assert sizes == grammar.lengths.tolist()


def test_long_runs_and_copies_take_few_rules():
    assert len(grammar_of([[1] * 100_000], 2).symbols) < 20
    rng = random.Random(1)
    text = [rng.randrange(1000) for _ in range(500)]
    grammar = grammar_of([text] * 50, 1000)
    assert len(grammar.symbols) <= 50 * 8
    assert grammar.document(37, 100, 140).tolist() == text[100:140]


def test_damaged_bytes_are_refused():
    with pytest.raises(ValueError):
        Grammar.from_bytes(b"\0" * 64)


@pytest.fixture(scope="module")
def tokenizer():
    return tokenfile.load_tokenizer(PATH)


@pytest.mark.parametrize("limit", [tokenfile.KNOWN_WORDS, 20])
def test_words_are_encoded_as_in_their_text(tokenizer, limit):
    encoder = tokenfile.Encoder(tokenizer, limit)
    assert encoder.words is not None
    rng = random.Random(3)
    alphabet = "aAbB'sS 1.,!\t\n\x0b\x0c\r\x1c\x85\xa0 éÉéßΣσİ日\U0001f600<|endoftext|>"
    texts = ["", " ", "<|endoftext|> a", "it's  'S", "́a ́", "x" * 5000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, ids in zip(some, encoder.apply(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_of_letters_by_the_model_alone(tokenizer):
    letters, rng = tokenfile.Letters(tokenizer), random.Random(8)
    assert letters.usable
    alphabet = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêíñóöúüÿ"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(5000)]
    assert letters.ids(words) == [
        np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words
    ]
    assert not letters.SMALL.fullmatch("a÷b")
    other = tokenfile.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tokenfile.Letters(other).usable


def test_other_tokenizers_see_whole_texts():
    other = tokenfile.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokenfile.Encoder(other)
    assert encoder.words is None
    ids = np.frombuffer(encoder.apply(["a  b c"])[0], "<u4").tolist()
    assert ids == other.encode("a  b c", add_special_tokens=False).ids


def expected(tokenizer, rows: list[tuple]) -> list[tuple]:
    out, start = [], 0
    for name, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, tokenizer):
    folder = TESTDATA / "sf0.001"
    docs = spark.read.parquet(str(folder / "documents.parquet")).orderBy("doc_id").collect()
    out = sorted(tuple(r) for r in op12_repair(spark, str(folder)).collect())
    assert out == expected(tokenizer, [(r.doc_id, r.text) for r in docs])


def test_many_shards_nulls_repeats_and_ranges(spark, tokenizer, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma's", "δ", "42"]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for k in range(120)}
    rows = [(k, t, 0, "x") for k, t in texts.items()] + [(200, None, 0, "x"), (201, "", 1, "y")]
    rows += [(300, "same text", 1, "z")] * 3
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int, grammar string").repartition(5)
    folder = str(tmp_path / "files")
    tokenfile.write(docs, folder, PATH, shard_ids=700)
    stored = spark.read.parquet(f"{folder}/shards")
    assert stored.count() > 10
    found = tokenfile.read(spark, folder)
    out = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found.collect())
    assert out == expected(tokenizer, sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]))
    whole = b"".join(bytes(r.ids) for r in found.orderBy("start").collect())
    ids = np.frombuffer(whole, "<u4").tolist()
    for first, count in ((0, 1), (650, 2000), (len(ids) - 3, 10), (5, 0)):
        parts = tokenfile.read_range(spark, folder, first, count).orderBy("start").collect()
        assert [i for r in parts for i in r.ids] == ids[first : first + count]


def test_null_ids_come_first_and_empty_tables(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([("b", "x y"), (None, "z"), ("a", None)], "doc_id string, text string")
    tokenfile.write(docs, str(tmp_path / "some"), PATH)
    out = [tuple(r)[:3] for r in tokenfile.read(spark, str(tmp_path / "some")).orderBy("start").collect()]
    assert out == [(None, 0, 2), ("a", 2, 1), ("b", 3, 3)]
    tokenfile.write(docs.where("false"), str(tmp_path / "none"), PATH)
    assert tokenfile.read(spark, str(tmp_path / "none")).collect() == []


def test_words_taken_apart_at_marks_are_as_the_library_has_them():
    rng = random.Random(9)
    letters, marks = "abzÉéßÿ×÷1²ªµx́İ１", tokenfile.MARKS + "'s<|"
    words = [
        "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))
        + "".join(rng.choice(marks) for _ in range(rng.randint(0, 4)))
        + "".join(rng.choice(letters) for _ in range(rng.randint(0, 2)))
        for _ in range(8000)
    ]
    texts = [" ".join(words[i : i + 7]) + rng.choice(["", " ", "\n\x85", "\xa0"]) for i in range(0, 8000, 7)]
    encoder = tokenfile.Encoder(tokenfile.load_tokenizer(PATH))
    expected = tokenfile._packed(tokenfile.load_tokenizer(PATH), texts)
    assert encoder.by_marks and encoder.apply(texts) == expected
    assert tokenfile.Encoder(tokenfile.load_tokenizer(PATH), limit=40).apply(texts) == expected
    assert encoder.apply([]) == [] and encoder.apply(["", "  "]) == [b"", b""]


def test_pairs_are_numbered_where_hashes_collide(monkeypatch):
    """What a table by hash finds is what a search finds, with few hashes or many."""
    rng = np.random.default_rng(4)
    for bits in (3, 8, 20):
        monkeypatch.setattr(repair, "_HASH_BITS", bits)
        left, right = rng.integers(0, 60, (2, 5000)).astype(np.uint32)
        keys = left.astype(np.int64) * 60 + right
        chosen = np.unique(rng.choice(keys, 400))
        at = repair._numbers(chosen, keys, 60, repair._hashes(left, right))
        place = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
        assert at.tolist() == np.where(chosen[place] == keys, place, -1).tolist()
        assert (at >= 0).any() and (at < 0).any()


def test_letters_of_many_words_at_once():
    words = ["", "a", "aß", "÷", "a÷", "É", "éÿ", "a1", "it's", "x\n", "日", "zþ"]
    assert tokenfile.Letters.small(words) == [bool(tokenfile.Letters.SMALL.fullmatch(w)) for w in words]
    assert tokenfile.Letters.small([]) == []
