"""Words of whole texts as numpy arrays, for operators that work in Arrow batches.

A batch of texts is one buffer of UTF-8 bytes. Word borders, 64-bit word hashes and n-gram hashes come
from array operations over that buffer, so no Python runs per word. Byte-sized temporaries are bounded
by ``BLOCK`` (or the longest word), whatever the length of a text; word-sized arrays by ``chunks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _alphabet(word_bytes: np.ndarray, lower: bool) -> np.ndarray:
    """For each byte the byte it counts as; 0 for separators."""
    table = np.where(word_bytes, np.arange(256), 0).astype(np.uint8)
    if lower:
        table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


_bytes = np.arange(256)
_spaced = ~np.isin(_bytes, [0x20, *range(0x09, 0x0E)])
#: Byte 0 would be taken for a separator; it counts as byte 0xC0, which UTF-8 never uses.
SPACED = _alphabet(_spaced, lower=False)
SPACED[0] = 0xC0
SPACED_LOWER = _alphabet(_spaced, lower=True)
SPACED_LOWER[0] = 0xC0
ALNUM_LOWER = _alphabet((_bytes >= 0x80) | ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)), lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts; text ``t`` has the words ``first[t]`` up to ``first[t + 1]``."""

    data: np.ndarray  # the bytes of all texts
    bounds: np.ndarray  # where each text starts in data, and the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words at which an n-gram inside one text starts, and its hashes."""
        if len(self) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        last = len(self) - n + 1
        h = self.hash[:last].copy()
        for i in range(1, n):
            h = mix(h) * _STEP + self.hash[i : last + i]
        at = np.flatnonzero(self.text[:last] == self.text[n - 1 :])
        return at, mix(h[at] + np.uint64(n))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(bounds):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array, alphabet: np.ndarray, hashed: bool = True) -> Words:
    """The words of the texts: longest runs of bytes that the alphabet does not map to 0."""
    data, bounds = raw(texts)
    starts, ends, hashes = [], [], []
    border = np.zeros(len(data) + 1, bool)
    border[bounds] = True
    at = 0
    while at < len(data):
        stop = _cut(data, border, alphabet, min(at + BLOCK, len(data)))
        part = alphabet[data[at:stop]]
        inside = part != 0
        before = np.concatenate(([False], inside[:-1]))
        s = np.flatnonzero(inside & (~before | border[at:stop]))
        after = np.concatenate((inside[1:], [False]))
        e = np.flatnonzero(inside & (~after | border[at + 1 : stop + 1])) + 1
        starts.append(s + at)
        ends.append(e + at)
        if hashed and len(s):
            part, own = part[s[0] :], s - s[0]
            place = np.arange(len(part)) - np.repeat(own, np.diff(np.append(own, len(part))))
            powers = np.full(place.max() + 1, _STEP, np.uint64)
            powers[0] = 1
            weight = np.cumprod(powers)[place]
            value = np.where(part != 0, _BYTE[part], np.uint64(0))
            hashes.append(mix(np.add.reduceat(value * weight, own)))
        at = stop
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return Words(data, bounds, start, end, h, np.searchsorted(start, bounds))


def _cut(data: np.ndarray, border: np.ndarray, alphabet: np.ndarray, stop: int) -> int:
    """The first place from ``stop`` on where no word goes across."""
    while stop < len(data):
        ahead = slice(stop, min(stop + BLOCK, len(data)))
        free = np.flatnonzero((alphabet[data[ahead]] == 0) | border[ahead])
        if len(free):
            return stop + int(free[0])
        stop = ahead.stop
    return stop


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``size`` bytes of text each, one text at least."""
    _, bounds = raw(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list array with ``counts[i]`` of the values in row i."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind or pa.array(values[:0]).type))
