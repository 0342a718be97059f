"""Spelling variants: words that differ by one letter, found through a variable-length gram index.

Words. The runs of the letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased; counted over the whole
corpus, those of ``LEAST`` code points and ``OFTEN`` occurrences are kept.

Dictionary. Words are read between two border marks. Every pair of characters is a gram; a pair that occurs in more than
``PRUNE`` of all places is split into its extensions by one more character, so frequent pairs have longer grams and
rare ones are pruned to themselves. With 92 characters there are at most 92^2 + 92^3 grams, whatever the
corpus: that bounds what is broadcast (9 MB).

Decomposition. At each place the longest gram of the dictionary, unless it lies within one before it.

Affected grams. Changing the character at place i can alter the grams that start at i - 2 (if the pair there is split;
else i - 1) or later and end before i + 3; all others stay, at the same distance from the left or the right border. The most over all i
is the word's bound, 4 at most. A word of five characters or more always keeps a gram (``LEAST``), so no
near word escapes.

Merging. Of a word's grams, rarest first, one more than its bound are looked up: two near words share the
rarest of the grams that both keep, and nothing but affected grams can come before it in either. Lists are
kept by gram, length, side and distance from that border. Two members are compared by the letters they hold (one
change alters two of 64 bits at most) and verified by their edit distance, inside the join; only near pairs leave it.

Roots. A form has at least twice its word's n, so chains are no longer than log2(n); pointers are doubled.

Scale. Occurrences are summed before the shuffle. What follows works on distinct words: five lookups in three lists and
five entries in two for each. Lists are joined, never gathered, and a long one can be split.

Rows. Null and empty texts have no words. With a null doc_id no letter is deleted. Repeated rows count one by one; an
empty table gives an empty result. Other columns are not read. A very long run is a word like any other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import durable
from llm.words import chunks, mix, raw

#: The shortest word: twice the longest gram, less one.
LEAST = 5
OFTEN = 3
#: One letter goes from an occurrence whose checksum this divides.
SLIP = 97
#: Pairs above this share of all places are split.
PRUNE = 1 / 32768
#: Runs up to this many bytes have their checksums computed side by side; and rows of counts that a task holds.
LONG = 64
HELD = 1 << 18

_bytes = np.arange(256)
_LETTER = ((_bytes | 0x20) >= ord("a")) & ((_bytes | 0x20) <= ord("z")) & (_bytes < 0x80)
_LOWER = np.where(_LETTER, _bytes | 0x20, _bytes).astype(np.uint8)
_CRC = _bytes.astype(np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)

CHARS = 92
_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[0xC0:0x100] = np.arange(27, 91)
_END = 91


def _tally(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _checksums(letters: np.ndarray, first: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of byte runs, each carried on from that of its prefix, one place of all runs at a time."""
    out = ~state
    order = np.argsort(-size, kind="stable")
    first, size, now = first[order], size[order], out[order]
    for place in range(min(int(size[0]), LONG) if len(size) else 0):
        live = int(np.searchsorted(-size, -place))
        now[:live] = _CRC[(now[:live] ^ letters[first[:live] + place]) & 0xFF] ^ (now[:live] >> 8)
    for i in np.flatnonzero(size > LONG):
        now[i] = ~np.uint32(zlib.crc32(letters[first[i] + LONG : first[i] + size[i]].tobytes(), int(~now[i])))
    out[order] = ~now
    return out


def occurrences(texts: pa.Array, ids: pa.Array) -> pa.Table:
    """(word, n) of a few texts, slips applied."""
    data, bounds = raw(texts)
    lead = data == 0xC3  # of the characters U+00C0 to U+00FF
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    border = np.zeros(len(data) + 1, bool)
    border[bounds] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | border[:-1]))
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | border[1:])) + 1
    letters = _LOWER[data[inside]]
    size = end - start
    cuts = np.concatenate(([0], np.cumsum(size)))
    named = [None if i is None else zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()]
    text = np.searchsorted(bounds, start, "right") - 1
    prefix = np.array([i or 0 for i in named], np.uint32)[text]
    slips = (_checksums(letters, cuts[:-1], size, prefix) % SLIP == 0) & np.array([i is not None for i in named], bool)[text]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(cuts), pa.py_buffer(letters))
    changed = []
    for i in np.flatnonzero(slips):
        run = letters[cuts[i] : cuts[i + 1]].tobytes()
        word = run.decode()
        at = zlib.crc32(run, named[text[i]]) % len(word)
        changed.append(word[:at] + word[at + 1 :])
    words = pa.concat_arrays([words.filter(pa.array(~slips)), pa.array(changed, pa.large_string())])
    words = words.filter(pc.greater_equal(pc.utf8_length(words), LEAST))
    return _tally([pa.table({"word": words, "n": pa.array(np.ones(len(words), np.int64))})])


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the corpus, from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in chunks(batch, "text"):
                held.append(occurrences(part.column(1), part.column(0)))
                if sum(t.num_rows for t in held) > HELD:
                    held = [_tally(held)]
                    if held[0].num_rows > HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from _tally(held).to_batches()

    found = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def coded(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the numbers of its words, and their characters between border marks as rows of codes."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(values.to_pylist()).encode("latin-1"), np.uint8)
    first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        rows = np.zeros((len(own), n + 2), np.int64)
        rows[:, 1:-1] = _CODE[letters[first[own][:, None] + np.arange(n)]]
        rows[:, -1] = _END
        yield own, rows


def _pairs(rows: np.ndarray) -> np.ndarray:
    return rows[:, :-1] * CHARS + rows[:, 1:]


def decompose(rows: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of words of one length: the gram there, its end, and whether it is kept.

    A gram's code is that of its pair, or CHARS^2 and more for three characters.
    """
    pair = _pairs(rows)
    long = split[pair]
    long[:, -1] = False  # nothing follows
    gram = pair.copy()
    gram[:, :-1] = np.where(long[:, :-1], CHARS**2 + pair[:, :-1] * CHARS + rows[:, 2:], pair[:, :-1])
    end = np.arange(pair.shape[1]) + 2 + long
    before = np.maximum.accumulate(end, axis=1)
    kept = np.ones_like(long)
    kept[:, 1:] = end[:, 1:] > before[:, :-1]
    return gram, end, kept


def affected(rows: np.ndarray, split: np.ndarray, end: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The most grams of each word that one changed character can alter."""
    n, places = len(rows), kept.shape[1]
    ext = split[_pairs(rows)]
    # places before and behind the word hold no gram
    hold = np.zeros((n, places + 4), bool)
    hold[:, 2 : places + 2] = kept
    ends = np.zeros((n, places + 4), np.int64)
    ends[:, 2 : places + 2] = end
    i = np.arange(1, rows.shape[1] - 1)
    begin = np.where(i >= 2, i - 1 - ext[:, np.maximum(i - 2, 0)], i - 1)
    total = np.zeros((n, len(i)), np.int64)
    for step in (-2, -1, 0, 1):
        p = i + step
        total += hold[:, p + 2] & (p >= begin) & (ends[:, p + 2] <= i + 3)
    return total.max(axis=1)


def gram_counts(vocabulary: DataFrame, split: np.ndarray | None = None) -> np.ndarray:
    """How often each gram occurs in the words (each once): of all pairs, or of the grams that they decompose to."""
    size = CHARS**2 if split is None else CHARS**2 + CHARS**3
    shared = None if split is None else vocabulary.sparkSession.sparkContext.broadcast(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, rows in coded(batch.column(0)):
                if shared is None:
                    found = _pairs(rows).ravel()
                else:
                    gram, _, kept = decompose(rows, shared.value)
                    found = gram[kept]
                total += np.bincount(found, minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["gram", "n"])

    found = vocabulary.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _key(side: int, length: np.ndarray | int, gram: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """One number for a list; should two lists share it, verification tells their members apart."""
    h = mix(gram.astype(np.uint64) * np.uint64(2) + np.uint64(side))
    return mix(mix(h + distance.astype(np.uint64)) + np.uint64(length)).view(np.int64)


def _held_letters(rows: np.ndarray) -> np.ndarray:
    """64 bits a word: which of 32 classes of letters it holds, and which of them more than once."""
    once, twice = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for column in rows[:, 1:-1].T:
        bit = np.uint64(1) << (column % 32).astype(np.uint64)
        twice |= once & bit
        once |= bit
    return (once | twice << np.uint64(32)).view(np.int64)


def _one_change(a: Column, b: Column) -> Column:
    """Whether b, which is not a and no shorter, is a with one character inserted or replaced.

    The edit distance takes the square of the length, so long words are compared up to and from their first difference.
    """
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    at = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), F.length(a) + 1).cast("int")
    rest = lambda word, begin: F.substring(word, begin, F.length(word))
    replaced = (F.length(a) == F.length(b)).cast("int")
    linear = (F.length(b) - F.length(a) <= 1) & (rest(a, at + replaced) == rest(b, at + 1))
    return F.when(F.length(b) > LONG, linear).otherwise(F.levenshtein(a, b, 1) == 1)


def near(vocabulary: DataFrame, prune: float = PRUNE) -> DataFrame:
    """Rows (a, a_n, b, b_n): each pair of words that are near, once, from distinct words (word, n)."""
    context = vocabulary.sparkSession.sparkContext
    pairs = gram_counts(vocabulary)
    split = pairs > prune * pairs.sum()
    counts = gram_counts(vocabulary, split)
    index = context.broadcast((split, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = index.value
        for batch in batches:
            for own, rows in coded(batch.column(0)):
                length = rows.shape[1]
                gram, end, kept = decompose(rows, split)
                bound = affected(rows, split, end, kept)
                letters = np.zeros(batch.num_rows, np.int64)
                letters[own] = _held_letters(rows)
                word, place = np.nonzero(kept)
                gram, end = gram[word, place], end[word, place]
                order = np.lexsort((place, gram, counts[gram], word))
                word, place, gram, end = word[order], place[order], gram[order], end[order]
                rank = np.arange(len(word)) - np.searchsorted(word, word)
                ok = rank <= bound[word]
                word, place, gram, end = own[word[ok]], place[ok], gram[ok], end[ok]
                behind = length - end
                keys = [
                    (_key(0, length, gram, place), True),
                    (_key(1, length, gram, behind), True),
                    (_key(0, length, gram, place), False),
                    (_key(0, length + 1, gram, place), False),
                    (_key(1, length + 1, gram, behind), False),
                ]
                for key, listed in keys:
                    at = pa.array(word)
                    yield pa.record_batch(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(letters[word]), pa.array(np.full(len(key), listed))],
                        ["word", "n", "key", "letters", "listed"],
                    )

    entries = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, key long, letters long, listed boolean")
    # entries and lookups of a list meet in one shuffle
    entries = entries.repartition("key")
    x = entries.where("not listed").select("key", "letters", F.col("word").alias("a"), F.col("n").alias("a_n")).alias("x")
    y = entries.where("listed").select("key", "letters", F.col("word").alias("b"), F.col("n").alias("b_n")).alias("y")
    likely = F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters"))) <= 2
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    alike = likely & once & _one_change(F.col("a"), F.col("b"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & alike).select("a", "a_n", "b", "b_n").distinct()


def group(vocabulary: DataFrame, prune: float = PRUNE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    pairs = durable(near(vocabulary, prune))
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    first = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    partners = ways.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    best_n = -F.col("best.less")
    known = vocabulary.join(partners, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= 2 * F.col("n"), F.col("best.other")).alias("form"), best_n.alias("best_n")
    )
    known = durable(known)
    moved = durable(known.where("form is not null").select("word", F.col("form").alias("root")))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log2(most / OFTEN + 1)))  # the longest chain: n doubles along it
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = moved.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(moved.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return known.join(moved, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")
    )


def find(docs: DataFrame) -> DataFrame:
    """The words of (doc_id, text) with n_near, form (near word of largest n, if at least twice as frequent) and root."""
    return group(durable(words(docs)))
