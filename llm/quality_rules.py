"""Quality rules: base counts and a calibrated n-gram classifier with a fixed threshold.

Base. Counted over whole texts, see ``schema``; a document fails with fewer than 20 words, or if over 30 % of its
words lie in repeated 8-word windows. Documents that pass are judged by the classifier of ``llm.linear``,
trained on labelled rows (1 good, 0 bad): one is kept if its probability of being good is at least ``THRESHOLD``.

Training rows. ``MAX_LABELLED`` at most, the first by hash of their doc_id, half of them of each label; this bounds what
the one training task holds (16 KiB a row). Everything else is over all rows.

Scale. The sample of ids is broadcast (bounded); scoring is one map over the table, without a shuffle.

Rows. Null and empty texts have no words and fail. Null labels are not used. With labels of one
kind or none there is no classifier, and all that pass the base are kept. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.linear import Model, fit_rows
from llm.words import SPACED, Words, chunks, mix, words

MAX_LABELLED = 3000
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"
schema = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, probability double, kept boolean"
)

_LINES = np.arange(256, dtype=np.uint8)
_LINES[0], _LINES[10] = 0xC0, 0
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of the flags of bytes or words, the number in each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(text: np.ndarray, hashes: np.ndarray, later_only: bool) -> np.ndarray:
    """Which hashes occur twice or more in their text; with ``later_only`` all but one of each."""
    key = mix(hashes + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable" if later_only else None)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    if not later_only:
        out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``length`` words that starts at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def base_counts(texts: pa.Array, w: Words) -> dict[str, np.ndarray]:
    word_byte = SPACED[w.data] != 0
    n_words = w.counts
    lines = words(texts, _LINES)
    total = np.concatenate(([0], np.cumsum(word_byte & (w.data != 10), dtype=np.int64)))
    real = total[lines.end] > total[lines.start]
    again = np.zeros(len(lines), bool)
    again[real] = repeated(lines.text[real], lines.hash[real], later_only=True)
    at, grams = w.grams(8)
    twice = at[repeated(w.text[at], grams, later_only=False)]
    return {
        "n_words": n_words,
        "word_chars": per_text(word_byte & ((w.data & 0xC0) != 0x80), w.bounds),
        "n_symbols": per_text(_IS_SYMBOL[w.data], w.bounds),
        "n_dup_lines": per_text(again, lines.first),
        "n_repeat_words": per_text(covered(twice, 8, len(w)), w.first),
    }


def sample_labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, good) of at most ``most`` labelled documents."""
    ids = None
    for good in (0, 1):
        own = labels.where((F.col("quality") == good) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(good).alias("good"))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        ids = own if ids is None else ids.union(own)
    return docs.select("doc_id", "text").join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id").select("text", "good").limit(2 * most)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    return fit_rows(sample_labelled(docs, labels, most))


def _score(texts: pa.Array, model: Model | None, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base failures, probabilities and verdicts of some texts."""
    w = words(texts, SPACED)
    counts = base_counts(texts, w)
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    p = model.probability(w) if model else np.ones(len(texts))
    return counts, failed, p, ~failed & (p >= threshold)


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with the columns that they have."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield part.filter(pa.array(_score(part.column(place), model, threshold)[3]))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, see ``schema``; probability is null without a model."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, failed, p, kept = _score(part.column(1), model, threshold)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(failed)]
                probability = pa.array(p) if model else pa.nulls(part.num_rows, pa.float64())
                yield pa.record_batch([*columns, probability, pa.array(kept)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
