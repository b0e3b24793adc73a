"""SentencePiece encoding and decoding by a table of distinct chunks.

When no piece holds a character before a whitespace marker, merges never cross
the start of a marked word, so every marked word can be segmented on its own.
Characters that occur in no longer piece are chunks of their own as well. Each
task keeps a table from chunk to ids and text, segments every new chunk once
with the library, and joins the ids back by position. The table is bounded: a
full one starts anew. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from casefile.llm.chunks import in_chunks

TABLE_CHUNKS = 800_000
MARK = "▁"


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def chunk_pattern(model) -> re.Pattern[str]:
    """Splits a marked text into chunks that are segmented on their own.

    Raises ValueError if a piece crosses a whitespace marker.
    """
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    ]
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
        raise ValueError("pieces cross whitespace markers: chunks are not independent")
    joining = {c for piece in pieces if len(piece) > 1 for c in piece} - {MARK}
    inside = "".join(map(re.escape, sorted(joining)))
    return re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]", re.DOTALL)


class ChunkTable:
    """Ids and text of the chunks seen so far, in one task."""

    def __init__(self, model, limit: int = TABLE_CHUNKS):
        self.model, self.limit = model, limit
        self.pattern = chunk_pattern(model)
        self.ids: dict[str, str] = {}
        # Only chunks that are not decoded to themselves.
        self.changed: dict[str, str] = {}
        # The library puts a marker before a text. Chunks must get none, so they
        # are encoded after a line feed, whose ids are then cut off.
        self.lead = len(model.encode("\n"))
        self.lead_text = len(model.decode(model.encode("\n")))

    def _learn(self, fresh: list[str]) -> None:
        coded = self.model.encode(["\n" + c for c in fresh], num_threads=1)
        texts = self.model.decode(coded, num_threads=1)
        for chunk, ids, text in zip(fresh, coded, texts, strict=True):
            self.ids[chunk] = ",".join(map(str, ids[self.lead :]))
            if text[self.lead_text :] != chunk.replace(MARK, " "):
                self.changed[chunk] = text[self.lead_text :]

    def apply(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids joined by commas, and the decoded text, for
        each text. New chunks of all the texts are segmented in one call."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        chunks = [self.pattern.findall(m) for m in marked]
        found = [list(map(self.ids.get, c)) for c in chunks]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        fresh = {c for i in lacking for c, ids in zip(chunks[i], found[i], strict=True) if ids is None}
        if fresh and len(self.ids) + len(fresh) > self.limit:
            self.ids, self.changed = {}, {}
            lacking, fresh = range(len(texts)), set().union(*chunks)
        if fresh:
            self._learn(list(fresh))
            for i in lacking:
                found[i] = list(map(self.ids.get, chunks[i]))
        out = []
        for text, own, ids in zip(marked, chunks, found, strict=True):
            joined = ",".join(filter(None, ids))
            if self.changed:
                text = "".join(self.changed.get(c, c) for c in own)
            n = joined.count(",") + 1 if joined else 0
            out.append((n, joined, text.replace(MARK, " ")[1:]))
        return out


def encode(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """Adds to every row the number of ids of its text (``n_tokens``), the ids
    joined by commas (``piece_ids``) and their decoding (``decoded``); with
    ``digests``, SHA-256 of both in place of the values, and no text.

    Null texts count as empty: no ids. Texts are encoded whole; a long one costs
    memory in proportion to its own length. Every row is kept, repeats and all;
    columns named like an added one are replaced. ``model_path`` must exist on
    every machine.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "piece_ids", "decoded"]
    kept = [c for c in docs.columns if c not in added and not (digests and c == "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    schema += f", n_tokens bigint, {added[1]} string, {added[2]} string"
    place = kept + (["text"] if digests else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(load_model(model_path))
        for batch in batches:
            at = 0
            for _, texts in in_chunks([None] * batch.num_rows, batch.column("text").to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                counts, first, second = zip(*table.apply(texts), strict=True)
                if digests:
                    first = [hashlib.sha256(x.encode()).hexdigest() for x in first]
                    second = [hashlib.sha256(x.encode()).hexdigest() for x in second]
                columns = [part.column(c) for c in kept]
                columns += [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return docs.select(*place).mapInArrow(run, schema)
