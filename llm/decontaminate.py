"""Benchmark decontamination with an FM-index per shard of documents.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is ten consecutive words of a
benchmark item, or the whole item if it has fewer. A document word inside any occurrence of a window is hit.

Index. A shard is some 2 MB of documents. Words that no window holds can match nothing, so only runs of window words
long enough for a window are indexed, with separators between them (this loses no occurrence). From their suffix
array come the Burrows-Wheeler transform, a wavelet tree (levelwise, with rank counts) and sampled positions. All
windows are searched backward at once; occurrences walk to the next sampled position, and merge to spans.

Scale. One map over documents, no shuffle. Windows reach the tasks in blocks of ``BLOCK_BYTES`` of benchmark text, and a
task holds one block at a time, so the benchmark may grow; a shard is searched block by block. Memory is in
proportion to a shard, or to the longest document.

Rows. Null texts have no words. Items without words and null items have no windows; a null item_id is not reported,
but its windows hit. Items that share a window are all reported. Repeated rows are judged one by one.
Empty tables: no documents, no rows; no items, no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import ALNUM_LOWER, Words, chunks, lists, words

WINDOW = 10
BLOCK_BYTES = 16 << 20
SAMPLE = 8
schema = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>"


@dataclass
class Windows:
    """Windows of some items. ``places[length]``: words (numbers in the vocabulary) of each window of that length."""

    vocabulary: np.ndarray
    places: dict[int, np.ndarray]
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # of each window, from where and which items (numbers)
    items: pa.Array


def windows_of(items: pa.Array, texts: pa.Array, length: int = WINDOW) -> Windows:
    w = words(texts, ALNUM_LOWER)
    vocabulary, place = np.unique(w.hash, return_inverse=True)
    counts = w.counts
    places, owners = {}, {}
    for n in sorted({min(int(c), length) for c in counts if c}):
        whole = np.minimum(counts, length) == n
        at = np.flatnonzero(np.arange(len(w)) + n <= w.first[1:][w.text]) if len(w) else np.empty(0, np.int64)
        at = at[whole[w.text[at]]]
        rows = place[at[:, None] + np.arange(n)]
        unique, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), w.text[at]], axis=1), axis=0)
        places[n] = unique
        owners[n] = (np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1)), pairs[:, 1])
    return Windows(vocabulary, places, owners, items)


class WaveletTree:
    """Ranks of symbols in a sequence; one level per bit, each stably sorted by its bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = sequence >> bit & 1
            self.levels.append((np.concatenate(([0], np.cumsum(ones))).astype(np.int32), len(ones) - int(ones.sum())))
            sequence = np.concatenate((sequence[ones == 0], sequence[ones == 1]))
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            symbol = symbol << 1 | one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text ends with its only smallest symbol."""
    _, rank = np.unique(text, return_inverse=True)
    n, k = len(text), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FmIndex:
    """Over symbols 1 .. top and separators 0; the text ends with a separator."""

    def __init__(self, text: np.ndarray, top: int):
        breaks = text == 0
        n_breaks = int(breaks.sum())
        told_apart = text.astype(np.int64) + n_breaks
        # the last separator is the smallest, so that no suffix is a prefix of another
        told_apart[breaks] = np.arange(n_breaks)[::-1]
        order = suffix_array(told_apart)
        self.n = len(text)
        before = text[order - 1]
        self.tree = WaveletTree(before, max(1, int(top).bit_length()))
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        starts_run = np.concatenate(([True], breaks[:-1]))
        known = (np.arange(self.n) % SAMPLE == 0) | starts_run
        self.sample = np.where(known[order], order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that start with each pattern (a row of symbols)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for symbol in patterns.T[::-1]:
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text: steps back through the text until a place that is known."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            found = self.sample[at[todo]]
            done = found >= 0
            out[todo[done]] = found[done] + steps[todo[done]]
            todo = todo[~done]
            symbol = self.tree.access(at[todo])
            at[todo] = self.first[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
        return out


def _long_runs(inside: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in runs of at least ``least`` words inside, within one text."""
    if not len(inside):
        return inside
    new = np.concatenate(([True], (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])))
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(inside)))
    return np.repeat((size >= least) & inside[starts], size)


def hits(w: Words, known: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows in the texts: first word, length; and (text, item number) pairs."""
    none = np.empty(0, np.int64)
    if not len(w) or not known.places:
        return none, none, none, none
    text = w.text
    at = np.minimum(np.searchsorted(known.vocabulary, w.hash), len(known.vocabulary) - 1)
    symbol = np.where(known.vocabulary[at] == w.hash, at + 1, 0)
    keep = np.zeros(len(w), bool)
    for length, rows in known.places.items():
        used = np.zeros(len(known.vocabulary) + 1, bool)
        used[rows.ravel() + 1] = True
        keep |= _long_runs(used[symbol], text, length)
    kept = np.flatnonzero(keep)
    if not len(kept):
        return none, none, none, none
    gap = np.flatnonzero((np.diff(kept) != 1) | (np.diff(text[kept]) != 0)) + 1
    indexed = np.append(np.insert(symbol[kept], gap, 0), 0)
    source = np.append(np.insert(kept, gap, -1), -1)
    index = FmIndex(indexed, len(known.vocabulary))
    starts, lengths, texts, items = [], [], [], []
    for length, rows in known.places.items():
        low, high = index.search(rows + 1)
        n = high - low
        which = np.repeat(np.arange(len(rows)), n)
        row = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        start = source[index.locate(row)]
        starts.append(start)
        lengths.append(np.full(len(start), length))
        pair = np.unique(np.stack([text[start], which], axis=1), axis=0)
        first, owner = known.owners[length]
        many = first[pair[:, 1] + 1] - first[pair[:, 1]]
        texts.append(np.repeat(pair[:, 0], many))
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        items.append(owner[np.repeat(first[pair[:, 1]], many) + within])
    return tuple(np.concatenate(x) for x in (starts, lengths, texts, items))


def _judge(part: pa.RecordBatch, blocks: list) -> pa.RecordBatch:
    w = words(part.column(1), ALNUM_LOWER)
    n = part.num_rows
    edge = np.zeros(len(w) + 1, np.int64)
    texts, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for block in blocks:
        known = block.value
        start, length, text, item = hits(w, known)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        ids = known.items.take(pa.array(item))
        real = ids.is_valid().to_numpy(zero_copy_only=False)
        texts.append(text[real])
        items.append(ids.drop_null().to_numpy())
        if len(blocks) > 1:
            del block._value  # one block in memory at a time; the next use reads it again
    hit = np.cumsum(edge[:-1]) > 0
    pair = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)], axis=1), axis=0)
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[w.first[1:]] - total[w.first[:-1]]
    text = w.text
    new = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (text[1:] != text[:-1]))))if len(w) else np.empty(0, np.int64)
    last = np.flatnonzero(hit & np.concatenate((~hit[1:] | (text[1:] != text[:-1]), [True]))) if len(w) else np.empty(0, np.int64)
    points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    base = points[w.bounds[text[new]]]
    spans = pa.StructArray.from_arrays([pa.array(points[w.start[new]] - base), pa.array(points[w.end[last]] - base)], ["start", "end"])
    edges = np.searchsorted(text[new], np.arange(n + 1))
    spans = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)
    per = np.bincount(pair[:, 0], minlength=n)
    return pa.record_batch(
        [part.column(0), pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), lists(pair[:, 1], per, pa.int64()), spans],
        ["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, length: int = WINDOW) -> list:
    """The windows of the benchmark, broadcast in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    out = []
    for b in range(n):
        got = rows.where(block == b).toArrow().combine_chunks()
        if got.num_rows:
            known = windows_of(got.column(0).combine_chunks(), got.column(1).combine_chunks(), length)
            out.append(benchmark.sparkSession.sparkContext.broadcast(known))
    return out


def find(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, see ``schema``: items whose windows occur, merged spans in code points, end exclusive."""
    blocks = blocks_of(benchmark, block_bytes, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield _judge(part, blocks)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without an occurrence of a window, with the columns that they have; each row is judged by its text."""
    blocks = blocks_of(benchmark, block_bytes, length)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                narrow = pa.record_batch([pa.nulls(part.num_rows, pa.int64()), part.column(place)], ["doc_id", "text"])
                hit = _judge(narrow, blocks).column(2).to_numpy()
                yield part.filter(pa.array(hit == 0))

    return docs.mapInArrow(run, docs.schema)
