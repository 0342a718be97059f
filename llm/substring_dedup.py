"""Substring dedup: windows of words that an earlier document has, found exactly behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. Each word covered by a window whose words also start somewhere in
a document with a smaller doc_id is removed; windows are judged on the input.

First pass. Each task counts its windows (once per document) in a count-min sketch of ``ROWS`` rows, with counts up to two, and
sends it as the sorted cells it has touched, by blocks of cells. Blocks are merged cell by cell, and the cells
counted twice or more are broadcast as bits. Collisions only overestimate: no repeated window is lost.
Second pass. Windows all of whose cells are set are grouped exactly, by 64-bit hashes of their words, to find the smallest
doc_id; windows with a smaller one than their own go back to their document as places to remove.

Scale. The sketch has about as many cells a row as the table has bytes / 4, and ``MAX_CELLS`` at most: 2 ** 30 cells a row
are 256 MB of bits for both rows, the bound of the broadcast. Beyond some 4 GB of text a driver of
that size lets more unrepeated windows through to the exact grouping, which then shuffles more; results are the same at any size.
Within a chunk of documents, windows that a smaller doc_id of the chunk has are decided at once, so a very frequent
window sends one document's rows a chunk to the grouping. Tasks hold ``FLUSH`` windows at a time.

Rows. Null and empty texts have no words; the digest is that of the empty string. A document with a null doc_id is left
whole and removes nothing. Rows that share a doc_id do not remove each other's words. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.quality_rules import repeated
from llm.words import SPACED, Words, chunks, mix, raw, words

WINDOW = 13
ROWS = 2
MAX_CELLS = 1 << 30
BLOCK = 1 << 20
FLUSH = 2_000_000
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3))


def cells_for(n_bytes: int, most: int = MAX_CELLS) -> int:
    return int(min(most, max(BLOCK, 1 << max(0, int(n_bytes // 4 - 1)).bit_length())))


def _cell(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(h + _SALTS[row]) & np.uint64(cells - 1)


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** 32 as compressed byte planes of their steps."""
    steps = np.diff(values, prepend=0).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def sketch(docs: DataFrame, cells: int, window: int = WINDOW) -> np.ndarray:
    """The bits of the cells that count two or more, ROWS * cells / 8 bytes."""
    blocks = cells // BLOCK

    def flush(pending: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(pending)
        number, once, twice = [], [], []
        for row in range(ROWS):
            cell = np.sort(_cell(h, row, cells)).astype(np.int64)
            new = np.concatenate(([True], cell[1:] != cell[:-1]))
            again = np.unique(cell[~new])
            cell = cell[new]
            edges, edges2 = (np.searchsorted(x, np.arange(blocks + 1) * BLOCK) for x in (cell, again))
            for b in range(blocks):
                if edges[b] < edges[b + 1]:
                    number.append(row * blocks + b)
                    once.append(_pack(cell[edges[b] : edges[b + 1]] - b * BLOCK))
                    twice.append(_pack(again[edges2[b] : edges2[b + 1]] - b * BLOCK))
        return pa.record_batch([pa.array(number, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column(0), SPACED)
                at, h = w.grams(window)
                if len(h):
                    pending.append(h[~repeated(w.text[at], h, later_only=True)])
                if sum(map(len, pending)) >= FLUSH:
                    yield flush(pending)
                    pending = []
        if pending:
            yield flush(pending)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, seen, twice = block, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                cell = _unpack(a)
                twice[cell[seen[cell]]] = True
                seen[cell] = True
                twice[_unpack(b)] = True
        if now is not None:
            yield done()

    partial = docs.select("text").mapInArrow(count, "block long, once binary, twice binary")
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary").toArrow()
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for block, found in zip(merged.column(0).to_pylist(), merged.column(1), strict=True):
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(found.as_buffer(), np.uint8)
    return bits


def maybe_repeated(h: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        at = _cell(h[out], row, cells).astype(np.int64) + row * cells
        out[out] = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return out


def removals(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS) -> DataFrame:
    """(row, starts): the windows to remove by the number of their first word, for each ``row`` (hash of doc_id and text)."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells_for(n_bytes, max_cells)
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, cells, window))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column(2), SPACED)
                at, h = w.grams(window)
                ok = maybe_repeated(h, bits.value, cells)
                at, h = at[ok], h[ok]
                text = w.text[at]
                row, doc = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
                place = at - w.first[text]
                unique, which = np.unique(h, return_inverse=True)
                least = np.full(len(unique), np.iinfo(np.int64).max)
                np.minimum.at(least, which, doc)
                sure = doc > least[which]
                # decided here: such rows go where no others do, so a frequent window is one document's in each chunk
                h = np.where(sure, mix(row.view(np.uint64) + place.astype(np.uint64)), h)
                place = np.where(sure, -1 - place, place)
                yield pa.record_batch([pa.array(x) for x in (row, doc, h.view(np.int64), place)], ["row", "doc_id", "hash", "place"])

    likely = docs.where("doc_id is not null").select("row", "doc_id", "text").mapInArrow(pick, "row long, doc_id long, hash long, place long")
    likely = likely.withColumn("place", F.col("place").cast("int"))
    least = F.min("doc_id").over(Window.partitionBy("hash"))
    found = likely.withColumn("least", least).where("place < 0 OR doc_id > least")
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    return found.groupBy("row").agg(F.collect_list(place).alias("starts"))


def find(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept (the words left, spaced)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    starts = removals(rows, window, max_cells)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, bounds = raw(part.column(1))
                data = data.tobytes()
                n_words, n_removed, digests, left = [], [], [], []
                for i, at in enumerate(part.column(2)):
                    own = data[bounds[i] : bounds[i + 1]].split()
                    n_words.append(len(own))
                    if at.is_valid:
                        edge = np.zeros(len(own) + 1, np.int64)
                        at = np.unique(at.values.to_numpy())
                        edge[at] += 1
                        edge[at + window] -= 1
                        own = [own[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    n_removed.append(n_words[-1] - len(own))
                    kept = b" ".join(own)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode() if texts else None)
                columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.record_batch(columns + [pa.array(left, pa.string())] * texts, names + ["kept"] * texts)

    return rows.join(starts, "row", "left").select("doc_id", "text", "starts").mapInArrow(cut, schema)
