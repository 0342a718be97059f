"""Quality classifier from weak labels: heuristic labellers, expectation maximisation, a hashed linear scorer.

Labellers. Each of seven heuristics calls a text good, bad, or abstains; they overlap and none is right always.
The votes of all documents are counted by pattern (3 ** 7 at most). Expectation maximisation estimates from these
counts each labeller's rates in both classes, and the posterior of each pattern.

Scorer. Documents drawn by hash of their doc_id, ``MAX_TRAIN`` at most and half from each side of the posterior, train
the hashed linear scorer of ``llm.linear`` on their posterior labels. It then scores every whole text: one is
kept if it has a word and its probability of being good is at least ``THRESHOLD``.

Scale. Voting and scoring are maps; the shuffle holds pattern counts, and the driver the counts and the bounded sample.

Rows. Null and empty texts have no words: all labellers abstain, and they are not kept. If all posteriors are on one
side there is no scorer, and the posterior itself is the probability. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.linear import Model, fit_rows
from llm.quality_rules import per_text
from llm.shared import durable
from llm.words import SPACED, Words, chunks, words

MAX_TRAIN = 3000
THRESHOLD = 0.3
GOOD, BAD, ABSTAIN = 1, 0, 2

_bytes = np.arange(256)
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_LETTER = _UPPER | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 0x80)
_SYMBOL = np.isin(_bytes, list(b"#*$%&<>"))


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))


def votes(w: Words) -> np.ndarray:
    """A row per text, a column per labeller."""
    n = np.maximum(w.counts, 1)
    data = w.data
    size = np.maximum(np.diff(w.bounds), 1)
    letters = np.maximum(per_text(_LETTER[data], w.bounds), 1)
    symbols = per_text(_SYMBOL[data], w.bounds) / n
    upper = per_text(_UPPER[data], w.bounds) / letters
    pipes = per_text(data == ord("|"), w.bounds) / n
    exclaim = per_text(data == ord("!"), w.bounds) / n
    same = np.zeros(len(w), bool)
    if len(w) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    again = per_text(same, w.first) / n
    key = w.hash ^ (w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(w.text[at], minlength=len(n)) / n
    prose = letters / size
    out = np.stack(
        [
            _vote(symbols < 0.05, symbols > 0.3),
            _vote(upper < 0.15, upper > 0.4),
            _vote(pipes < 0.01, pipes > 0.05),
            _vote(exclaim < 0.05, exclaim > 0.2),
            _vote(again < 0.05, again > 0.15),
            np.where(w.counts < 40, ABSTAIN, _vote(distinct > 0.3, distinct < 0.15)),
            np.where(w.counts < 40, ABSTAIN, _vote(prose > 0.72, prose < 0.5)),
        ],
        axis=1,
    )
    out[w.counts == 0] = ABSTAIN
    return out


LABELLERS = 7
_POWERS = 3 ** np.arange(LABELLERS)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Rates[class, labeller, vote], the share of good documents and the posterior of good for each pattern.

    Starts from: bad if any labeller says so. What anchors the classes is that no labeller is worse than chance: one that says
    good of bad documents more often than of good ones, or bad of good ones, tells nothing in that round. Documents of which no
    labeller says anything take no part, and have the share as their posterior.
    """
    said = np.stack([patterns == v for v in (BAD, GOOD, ABSTAIN)], axis=2).astype(float)
    silent = (patterns == ABSTAIN).all(axis=1)
    counts = np.where(silent, 0.0, counts)
    any_bad = (patterns == BAD).any(axis=1)
    good = np.where(any_bad, 0.1, 0.95)
    total = max(counts.sum(), 1e-9)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        rates = np.einsum("cp,plv->clv", weight, said) + 0.01
        pooled = rates.sum(axis=0)
        rates /= rates.sum(axis=2, keepdims=True)
        worse = (rates[1, :, 1] < rates[0, :, 1]) | (rates[0, :, 0] < rates[1, :, 0])
        rates[:, worse] = (pooled / pooled.sum(axis=1, keepdims=True))[worse]
        share = np.clip(weight[1].sum() / total, 1e-6, 1 - 1e-6)
        log = np.einsum("plv,clv->pc", said, np.log(rates)) + np.log([1 - share, share])
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40)))
    return rates, float(share), np.where(silent, share, good)


def _patterns(code: np.ndarray) -> np.ndarray:
    return code[:, None] // _POWERS % 3


def vote_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                code = votes(words(part.column(1), SPACED)) @ _POWERS
                yield pa.record_batch([part.column(0), pa.array(code, pa.int32())], ["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pattern int")


def train(docs: DataFrame, most: int = MAX_TRAIN) -> tuple[Model | None, dict[int, float]]:
    """The scorer, and the posterior of each vote pattern."""
    coded = durable(vote_codes(docs))
    counted = coded.groupBy("pattern").count().orderBy("pattern").toArrow()
    if not counted.num_rows:
        return None, {}
    code, n = counted.column(0).to_numpy(), counted.column(1).to_numpy().astype(float)
    _, _, good = expectation_maximisation(_patterns(code), n)
    posterior = dict(zip(code.tolist(), good.tolist(), strict=True))
    silent = int((np.full(LABELLERS, ABSTAIN) * _POWERS).sum())
    sides = [[c for c, p in posterior.items() if (p >= 0.5) == side and c != silent] for side in (False, True)]
    if not all(sides):
        return None, posterior
    ids = None
    for codes in sides:
        own = coded.where(F.col("pattern").isin(codes) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        ids = own if ids is None else ids.union(own)
    known = F.create_map(*(F.lit(x) for c, p in posterior.items() for x in (c, p)))
    sample = ids.dropDuplicates(["doc_id"]).select("doc_id", F.element_at(known, F.col("pattern")).alias("good"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "good").limit(2 * most)
    return fit_rows(rows), posterior


schema = "doc_id long, n_words long, posterior double, probability double, kept boolean"


def judge(docs: DataFrame, model: Model | None, posterior: dict[int, float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, see ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(3**LABELLERS, 0.5)
        table[list(posterior)] = list(posterior.values())
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column(1), SPACED)
                weak = table[votes(w) @ _POWERS]
                p = model.probability(w) if model else weak
                kept = (p >= threshold) & (w.counts > 0)
                columns = [part.column(0), *(pa.array(c) for c in (w.counts, weak, p, kept))]
                yield pa.record_batch(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
