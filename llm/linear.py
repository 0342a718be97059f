"""A linear scorer over hashed word and character n-grams, for whole texts in Arrow batches.

Features of a text are counts over its length (and a little, so that a few words say less than many): single words and word pairs (white-space words, as they are), hashed to
``WORDS`` places, and character trigrams (of UTF-8 bytes), hashed to ``CHARS`` places. A pair of equal words has a
place of its own. The score is the logit of a logistic regression, calibrated on rows held out from
training (Platt scaling). The model is small and of fixed size, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import SPACED, Words, chunks, mix, words

WORDS = 1 << 12
CHARS = 1 << 12
SAME = 0
#: Added to the number of words and of characters that counts are divided by.
WORDS_MORE, CHARS_MORE = 20, 100
_TRI = np.uint32(0x9E3779B1)


def _word_places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the single words, and of the pair that starts at each word but the last of a text (else -1)."""
    single = 1 + (w.hash % np.uint64(WORDS - 1)).astype(np.int64)
    pair = np.full(len(w), -1, np.int64)
    if len(w) > 1:
        a, b = w.hash[:-1], w.hash[1:]
        place = 1 + (mix(a * np.uint64(3) + b) % np.uint64(WORDS - 1)).astype(np.int64)
        place[a == b] = SAME
        text = w.text
        pair[:-1] = np.where(text[:-1] == text[1:], place, -1)
    return single, pair


def _char_places(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    return ((d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * _TRI >> np.uint32(20)).astype(np.uint16)


def features(w: Words) -> np.ndarray:
    """Dense rows of WORDS + CHARS mean counts, for a few texts."""
    n = len(w.first) - 1
    out = np.zeros((n, WORDS + CHARS), np.float32)
    single, pair = _word_places(w)
    for t in range(n):
        own = slice(w.first[t], w.first[t + 1])
        places = np.concatenate((single[own], pair[own][pair[own] >= 0]))
        if len(places):
            out[t, :WORDS] = np.bincount(places, minlength=WORDS) / (len(single[own]) + WORDS_MORE)
        text = w.data[w.bounds[t] : w.bounds[t + 1]]
        if len(text) > 2:
            out[t, WORDS:] = np.bincount(_char_places(text), minlength=CHARS) / (len(text) - 2 + CHARS_MORE)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def probability(self, w: Words) -> np.ndarray:
        """The calibrated probability that each text is good; one pass over bytes and words."""
        n = len(w.first) - 1
        single, pair = _word_places(w)
        of_word = self.weights[:WORDS][single] + np.where(pair >= 0, self.weights[:WORDS][np.maximum(pair, 0)], 0)
        counts = w.counts
        score = _sums(of_word, w.first) / (counts + WORDS_MORE)
        if len(w.data) > 2:
            of_char = np.zeros(len(w.data), np.float32)
            for at in range(0, len(w.data) - 2, 1 << 20):
                part = w.data[at : at + (1 << 20) + 2]
                of_char[at : at + len(part) - 2] = self.weights[WORDS:][_char_places(part)]
            inner = np.maximum(w.bounds[1:] - 2, w.bounds[:-1])
            sums = np.concatenate(([0.0], np.cumsum(of_char, dtype=np.float64)))
            score = score + (sums[inner] - sums[w.bounds[:-1]]) / (inner - w.bounds[:-1] + CHARS_MORE)
        return sigmoid((score + self.bias) * self.scale + self.shift) if n else np.empty(0)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, rounds: int = 200, l2: float = 1e-3, seed: int = 7) -> Model:
    """Logistic regression by full-batch Adam; ``good`` may be soft labels in 0..1. A fifth is held out for calibration."""
    order = np.random.default_rng(seed).permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    spread = np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float32) / len(x)) + np.float32(4e-3)
    spread[SAME] /= 8  # one place against thousands: let it learn as fast as they do together
    z, y = x[used].astype(np.float32), good[used]
    z /= spread
    balance = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-6), 0.5 / max((y < 0.5).mean(), 1e-6)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        gap = ((sigmoid(z @ w + b) - y) * balance).astype(np.float32)
        g, gb = gap @ z / len(z) + np.float32(l2) * w, gap.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.03 / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b = b - rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    model = Model((w / spread).astype(np.float64), float(b))
    if len(held):
        model.scale, model.shift = _platt(x[held].astype(np.float64) @ model.weights + model.bias, good[held])
    return model


def _platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the scores by damped Newton steps, classes weighing alike.

    Targets are drawn in by one row of each class, so that classes that are fully apart have a finite optimum.
    """
    n1, n0 = max((good >= 0.5).sum(), 1), max((good < 0.5).sum(), 1)
    target = np.where(good >= 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good >= 0.5, 0.5 / n1, 0.5 / n0)
    unit = np.sqrt(np.mean(score**2)) + 1e-9
    x = np.stack([score / unit, np.ones_like(score)])

    def loss(t: np.ndarray) -> float:
        return float(np.sum(weight * (np.logaddexp(0, t @ x) - target * (t @ x))))

    t = np.array([1.0, 0.0])
    for _ in range(100):
        p = sigmoid(t @ x)
        g = x @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-4 * np.eye(2), g)
        size = 1.0
        while size > 1e-4 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return (float(t[0] / unit), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def fit_rows(rows: DataFrame) -> Model | None:
    """The model of a bounded frame (text, good) of sampled rows; None if their labels are of one kind, or there are none.

    Features come from many tasks, 16 KiB a row; one task fits on them, and only the weights come to the driver.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                for at in range(0, part.num_rows, 64):
                    few = part.slice(at, 64)
                    x = features(words(few.column(0), SPACED)).astype(np.float16)
                    yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), few.column(1)], ["x", "good"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("x", pa.binary()), ("good", pa.float64())]))
        good = got.column("good").to_numpy()
        if len(np.unique(good >= 0.5)) < 2:
            return
        x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WORDS + CHARS)
        # an order that does not depend on the partitions
        order = np.lexsort((x[:, WORDS:].sum(axis=1, dtype=np.float32), x[:, :WORDS:7].sum(axis=1, dtype=np.float32), good))
        m = fit(x[order], good[order])
        numbers = [pa.array([float(v)]) for v in (m.bias, m.scale, m.shift)]
        yield pa.record_batch([pa.array([m.weights.tobytes()], pa.binary()), *numbers], ["weights", "bias", "scale", "shift"])

    few = rows.select("text", F.col("good").cast("double").alias("good")).mapInArrow(extract, "x binary, good double")
    found = few.repartition(1).mapInArrow(train, "weights binary, bias double, scale double, shift double").first()
    return Model(np.frombuffer(found.weights, np.float64), found.bias, found.scale, found.shift) if found else None
