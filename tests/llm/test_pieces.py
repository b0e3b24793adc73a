"""The chunk table against the library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest

from casefile.llm import pieces
from casefile.llm.queries import PIECE_MODEL, op5_pieces
from tests.compare import TESTDATA

PATH = public_tokenizers.path(PIECE_MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(PATH)


def made_texts() -> list[str]:
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b", "\n\n x", "▁", "a▁b ▁▁ c", "\x00 \x00a", "</s> <s>", "\r\n\t x", "é é", "a　b", "x" * 5000]
    alphabet = " ▁ab\né日\U0001f600<s>0x́."
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(2000)]


@pytest.mark.parametrize("limit", [pieces.TABLE_CHUNKS, 30])
def test_ids_and_text_match_the_library(model, limit):
    table, texts = pieces.ChunkTable(model, limit), made_texts()
    found = [row for at in range(0, len(texts), 50) for row in table.apply(texts[at : at + 50])]
    for text, (n, ids, decoded) in zip(texts, found, strict=True):
        expected = model.encode(text)
        assert (n, ids, decoded) == (len(expected), ",".join(map(str, expected)), model.decode(expected)), text


def test_whole_table(spark, model):
    folder = TESTDATA / "sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(folder / "documents.parquet")).collect()}
    out = op5_pieces(spark, str(folder)).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = model.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x", 3), (1, None, "x", 3), (None, "a b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, n_tokens int")
    out = sorted(pieces.encode(docs, PATH).select("n_tokens", "piece_ids", "decoded").collect())
    assert [tuple(r) for r in out] == [(0, "", ""), (0, "", ""), (2, "264,287", "a b")]
    assert pieces.encode(docs.where("false"), PATH).collect() == []
