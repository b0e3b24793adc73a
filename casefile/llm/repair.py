"""Re-Pair: a sequence of ids as a grammar of pairs, inside a task.

Frequent pairs of neighbouring symbols are replaced by new symbols, frequent ones
first, until no pair is frequent enough. A round replaces all pairs above a level
at once: where two occurrences overlap, the more frequent pair wins and the other
waits for the next round. Pairs never cross the end of a document, so each one has
its own symbols, and the expansion length of every rule leads to any place of it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

LEAST = 4
STEP = 8
_HASH_BITS = 20
_MIX = np.uint32(0x9E3779B1)
_OTHER = np.uint32(0x85EBCA77)
_HEAD = struct.Struct("<4sIIIIQ")
_MAGIC = b"RPG1"


@dataclass
class Grammar:
    """``symbols`` below ``base`` are ids, others name rules; document k has the
    symbols before ``symbol_ends[k]`` and the ids before ``token_ends[k]``."""

    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    symbol_ends: np.ndarray
    token_ends: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids that each symbol stands for."""
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        size[rule] = self.lengths[symbols[rule].astype(np.int64) - self.base]
        return size

    def expand(self, symbols: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the expansion of ``symbols``.
        Symbols whose expansion lies outside are never opened."""
        size = self.sizes(symbols)
        at = np.cumsum(size) - size
        whole = int(size.sum())
        last = whole if last is None else min(last, whole)
        first = min(first, last)
        out = np.empty(last - first, np.uint32)
        partial = first > 0 or last < whole
        while len(symbols):
            if partial:
                near = (at < last) & (at + self.sizes(symbols) > first)
                symbols, at = symbols[near], at[near]
            rule = symbols >= self.base
            out[at[~rule] - first] = symbols[~rule]
            opened = symbols[rule].astype(np.int64) - self.base
            left, right, at = self.left[opened], self.right[opened], at[rule]
            at = np.concatenate((at, at + self.sizes(left)))
            symbols = np.concatenate((left, right))
        return out

    def whole(self) -> np.ndarray:
        """All ids. Each rule is opened once and copied to where it stands, unless the
        rules together are longer than the ids."""
        size = self.sizes(self.symbols)
        total = int(size.sum())
        lengths = self.lengths.astype(np.int64)
        if not len(lengths) or int(lengths.sum()) > total:
            return self.expand(self.symbols)
        opened = self.expand(np.arange(self.base, self.base + len(lengths), dtype=np.uint32))
        # Symbols that are ids follow the opened rules, each for itself.
        rule = self.symbols >= self.base
        pool = np.concatenate((opened, self.symbols[~rule].astype(np.uint32)))
        start = np.empty(len(size), np.int64)
        start[rule] = (np.cumsum(lengths) - lengths)[self.symbols[rule].astype(np.int64) - self.base]
        start[~rule] = np.arange(len(opened), len(pool))
        place = np.repeat(start - (np.cumsum(size) - size), size)
        place += np.arange(total)
        return pool[place]

    def document(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` of document k."""
        begin = int(self.symbol_ends[k - 1]) if k else 0
        return self.expand(self.symbols[begin : int(self.symbol_ends[k])], first, last)

    def to_bytes(self) -> bytes:
        """A header, then little-endian arrays: left, right and length of every rule,
        ends of the documents in symbols and in ids, and the symbols."""
        head = _HEAD.pack(_MAGIC, self.base, len(self.left), len(self.symbol_ends), 0, len(self.symbols))
        parts = (self.left, self.right, self.lengths, self.symbol_ends)
        body = [p.astype("<u4").tobytes() for p in parts]
        body += [self.token_ends.astype("<u8").tobytes(), self.symbols.astype("<u4").tobytes()]
        return b"".join([head, *body])

    @staticmethod
    def from_bytes(data: bytes) -> Grammar:
        magic, base, rules, docs, _, symbols = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a grammar")
        at, found = _HEAD.size, []
        for kind, n in (("<u4", rules), ("<u4", rules), ("<u4", rules), ("<u4", docs), ("<u8", docs), ("<u4", symbols)):
            found.append(np.frombuffer(data, kind, n, at))
            at += found[-1].nbytes
        left, right, lengths, symbol_ends, token_ends, seq = found
        return Grammar(base, left, right, lengths, seq, symbol_ends, token_ends)


def _hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number of ``_HASH_BITS`` bits for every pair."""
    mixed = left * _MIX ^ (right + np.uint32(1)) * _OTHER
    return (mixed >> np.uint32(32 - _HASH_BITS)).astype(np.int64)


def _buckets(seq: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A bucket for every pair of neighbours, and one apart for pairs that would
    cross the end of a document."""
    bucket = _hashes(seq[:-1], seq[1:])
    bucket[last[:-1]] = 1 << _HASH_BITS
    return bucket


def _numbers(chosen: np.ndarray, keys: np.ndarray, width: int, bucket: np.ndarray) -> np.ndarray:
    """The place of each key in ``chosen`` (sorted, distinct), -1 of one that is not
    there; ``bucket`` has the keys' hashes. A table by hash has one chosen pair a hash,
    and only keys of a hash that has more are searched for among those."""
    own = _hashes((chosen // width).astype(np.uint32), (chosen % width).astype(np.uint32))
    table = np.full(1 << _HASH_BITS, -1, np.int32)
    table[own] = np.arange(len(chosen), dtype=np.int32)
    at = table[bucket]
    at[chosen[at] != keys] = -1
    beside = np.flatnonzero(table[own] != np.arange(len(chosen)))
    if len(beside):
        crowded = np.zeros(1 << _HASH_BITS, bool)
        crowded[own[beside]] = True
        rest = np.flatnonzero((at < 0) & crowded[bucket])
        other = beside[np.minimum(np.searchsorted(chosen[beside], keys[rest]), len(beside) - 1)]
        same = chosen[other] == keys[rest]
        at[rest[same]] = other[same]
    return at


def compress(ids: np.ndarray, token_ends: np.ndarray, base: int, least: int = LEAST) -> Grammar:
    """The grammar of documents that end before ``token_ends`` in ``ids``, all of
    them below ``base``. Rules are used ``least`` times or more when made.

    Each round takes the pairs at a level or above, which falls by ``STEP`` from
    round to round; the lowest level is repeated until no pair reaches it. A
    bucket's count bounds the counts of its pairs, so only pairs of full buckets are
    sorted and counted.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[token_ends[np.diff(token_ends, prepend=0) > 0] - 1] = True
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []
    made, level = 0, None
    # From the second round at the lowest level on, only pairs with a symbol of the
    # last round, or that lost an occurrence's contest in it, can be frequent.
    fresh: int | None = None
    waiting = np.zeros(len(seq), bool)
    while len(seq) > 1:
        if fresh is None:
            bucket = _buckets(seq, last)
            full = np.bincount(bucket, minlength=(1 << _HASH_BITS) + 1)
            full[-1] = 0
            most = int(full.max())
            level = max(least, (most if level is None else min(level, most)) // STEP)
            places = np.flatnonzero((full >= level)[bucket])
        else:
            new = seq >= fresh
            places = np.flatnonzero((new[:-1] | new[1:] | waiting[:-1]) & ~last[:-1])
        width = base + made
        keys = seq[places].astype(np.int64) * width + seq[places + 1]
        some = np.sort(keys)
        begins = np.flatnonzero(some[1:] != some[:-1]) + 1
        begins = np.concatenate((np.zeros(min(1, len(some)), np.int64), begins))
        counts = np.diff(begins, append=len(some))
        often = counts >= level
        done = _replace(seq, last, places, keys, some[begins[often]], counts[often], width, least)
        if done is None:
            if level == least:
                break
            continue
        seq, last, waiting, pairs = done
        lefts.append(pairs // width)
        rights.append(pairs % width)
        made += len(pairs)
        fresh = width if level == least else None
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    lengths = np.ones(base + made, np.int64)
    at = base
    for a, b in zip(lefts, rights, strict=True):
        # A round's rules only use symbols of earlier rounds.
        lengths[at : at + len(a)] = lengths[a] + lengths[b]
        at += len(a)
    filled = np.diff(token_ends, prepend=0) > 0
    symbol_ends = np.zeros(len(token_ends), np.int64)
    symbol_ends[filled] = np.flatnonzero(last) + 1
    symbol_ends = np.maximum.accumulate(symbol_ends) if len(symbol_ends) else symbol_ends
    return Grammar(base, left, right, lengths[base:], seq, symbol_ends, token_ends)


def _replace(seq, last, places, keys, chosen, counts, width, least):
    """The sequence with the ``chosen`` pairs replaced by ``width``, ``width`` + 1, …,
    its document ends, where a chosen pair is left, and the pairs that got a rule; None if no pair keeps ``least`` occurrences."""
    if not len(chosen):
        return None
    at = _numbers(chosen, keys, width, _hashes(seq[places], seq[places + 1]))
    hit = at >= 0
    places, at = places[hit], at[hit]
    waiting = np.zeros(len(seq), bool)
    waiting[places] = True
    priority = np.empty(len(chosen), np.int64)
    priority[np.argsort(-counts, kind="stable")] = np.arange(len(chosen))
    order = priority[at]
    # A run of one symbol: every other pair.
    index = np.arange(len(places))
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (np.diff(order) != 0)
    even = (index - np.maximum.accumulate(np.where(new, index, 0))) % 2 == 0
    places, at, order = places[even], at[even], order[even]
    near = np.diff(places) == 1
    wins = np.ones(len(places), bool)
    wins[1:] &= ~near | (order[1:] < order[:-1])
    wins[:-1] &= ~near | (order[:-1] < order[1:])
    places, at = places[wins], at[wins]
    enough = np.bincount(at, minlength=len(chosen)) >= least
    if not enough.any():
        return None
    used = enough[at]
    places, at = places[used], at[used]
    name = np.cumsum(enough) - 1 + width
    seq, last = seq.copy(), last.copy()
    seq[places] = name[at].astype(np.uint32)
    last[places] = last[places + 1]
    stays = np.ones(len(seq), bool)
    stays[places + 1] = False
    waiting[places] = False
    return seq[stays], last[stays], waiting[stays], chosen[enough]
