"""MinHash near-dedup with bottom-k sketches.

Sets. A document's set holds 64-bit hashes of its distinct shingles (``SHINGLE`` words each, A-Z lower-cased; the whole
sequence if it has fewer words). Documents with one set form a class, of which the smallest doc_id stands for all.

Sketches. From the one hash function, the ``K`` smallest values of each set; they estimate similarities.

Keys. What a set is listed by: its values fall into bins by another mixing of the hash, about ``PER_BIN`` a bin, and the first
few of each bin (``RUN``, or fewer for small sets and low thresholds) make one key. How likely linked sets have the same first values in
a bin follows from the threshold. There are so many bins, in several tables for small sets, that a pair at the threshold has
no key in common with a probability of about ``MISSED``, of ten times that at most where bins hold few values. Sets that are not alike rarely share several values at once, however
common each is, so lists do not grow with the table as those of single values do.

Candidates. Two sets that share a list of over ``SHORT`` members are both in the group of its smallest member, the hub. Other
pairs that share a list, and whose union-sketch estimates ``FLOOR`` or more, make up families (components), the smallest member being
the hub. Of a list whose members are like its smallest one only the pairs with that are estimated. So each linked pair is in the
group of some hub.

Verification. First each member against the hub, on full sets. Then members without a link to the hub, in blocks of
bounded size, with each other and with the linked ones; linked members need no more, they are in one component.
Estimates from the sketches come first, then intersections of full sets, both as products of membership matrices; a block
pair returns a spanning forest of its links, never all pairs. Components are joined by stars.

Scale. Shuffled are some 40 keys a set, the ``K`` values of list members, then the texts of list members only. Exact copies are one set, so their number
does not matter. A large group of near copies is split over tasks: ``PART`` members against the hub in each, and the
unlinked rest block by block.

Rows. Null and empty texts have the empty set, which is linked with nothing. A null doc_id is a node of its own that stands for no
other. Rows that share a doc_id are one node: it has the links of each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.components import components
from llm.shared import durable
from llm.words import SPACED_LOWER, Words, chunks, lists, mix, words

SHINGLE = 5
K = 64
FLOOR = 0.5
#: The most members of a short list.
SHORT = 32
#: Values that make a key, values of a bin on average, and how often a pair at the threshold may have no key in common.
RUN = 4
PER_BIN = 6
MISSED = 1e-9
PART = 512
#: Of the bit array that keeps texts outside all lists from being shuffled: 16 MB.
MAX_BITS = 1 << 27


def shingle_sets(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hash values of each text's set, one after the other, and where each begins."""
    at, h = w.grams(n)
    text = w.text[at]
    counts = w.counts
    few = np.flatnonzero((counts > 0) & (counts < n))
    whole = []
    for t in few:
        total = np.zeros(1, np.uint64)
        for x in w.hash[w.first[t] : w.first[t + 1]]:
            total = mix(total * np.uint64(31) + x)
        whole.append(mix(total + np.uint64(1000 + counts[t])))
    text = np.concatenate([text, few])
    h = np.concatenate([h, *whole]) if whole else h
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(len(w.first)))


def _tables(percent: int) -> list[tuple[int, float, int, int, int]]:
    """For each class of sets the sizes (from, below), the values of a key, bins of a table, and tables.

    Two linked sets are both in the class of the larger one: a class takes sizes from the threshold times its least size on.
    A class without two linked sets that differ is left out.
    """
    alike, out, least, last = percent / 100, [], 1, percent >= 100
    while not last:
        run = max(1, min(RUN, least.bit_length() - 1, int(np.log(0.3) / np.log(alike))))
        chance = 1.0
        for union in range(least, int(2 * least / alike) + 1):
            shared = -(-percent * union // 100)
            if shared < union and union + shared <= 2 * min(union, 2 * least - 1):
                # the first values of a bin are shared if those of the union are: so many drawn from it without replacement
                chance = min(chance, float(np.prod([(shared - i) / (union - i) for i in range(run)])))
        if chance < 1:
            keys = int(np.ceil(np.log(MISSED) / np.log(1 - chance)))
            tables = min(-(-keys * PER_BIN // least), keys)
            last = tables == 1
            out.append((int(np.ceil(least * alike)), np.inf if last else 2 * least, run, -(-keys // tables), tables))
        least *= 2
    return out


def set_keys(h: np.ndarray, first: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sets and their keys, by set; ``h`` and ``first`` are of :func:`shingle_sets`."""
    size = np.diff(first)
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for number, (low, high, run, bins, tables) in enumerate(_tables(percent)):
        chosen = np.flatnonzero((size >= max(low, 1)) & (size < high))
        if not len(chosen):
            continue
        n = size[chosen]
        values = h[np.arange(n.sum()) + np.repeat(first[:-1][chosen] - (np.cumsum(n) - n), n)]
        own = np.repeat(np.arange(len(chosen)), n)
        for table in range(tables):
            place = mix(values + np.uint64((table + 1) * 0xD6E8FEB86659FD93 % 2**64))
            bin_of = own * bins + ((place >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((place, bin_of))
            bin_of, weight = bin_of[order], mix(values[order] ^ np.uint64(0xA0761D6478BD642F))
            start = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
            start = start[np.diff(np.append(start, len(bin_of))) >= run]
            # the same values make the same key in whatever table
            key = np.full(len(start), number, np.uint64)
            for i in range(run):
                key += weight[start + i]
            owners.append(chosen[bin_of[start] // bins])
            keys.append(mix(key))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


def _keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, first = shingle_sets(words(part.column(1), SPACED_LOWER), n)
                size = np.diff(first)
                digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
                owner, key = set_keys(h, first, percent)
                keys = lists(key.view(np.int64), np.bincount(owner, minlength=len(size)), pa.int64())
                columns = [part.column(0), pa.array(size), pa.array(digest, pa.binary()), keys]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, first = shingle_sets(words(part.column(1), SPACED_LOWER), n)
                size = np.diff(first)
                kept = np.arange(len(h)) - np.repeat(first[:-1], size) < k
                sketch = lists(h[kept].view(np.int64), np.minimum(size, k), pa.int64())
                yield pa.record_batch([part.column(0), sketch], ["doc_id", "sketch"])

    return docs.mapInArrow(run, "doc_id long, sketch array<long>")


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents (doc_id, text) among (doc_id) of ids, and a few others, without a shuffle of texts.

    A bit array of fixed greatest size; the more ids it holds, the more others pass, which a join then drops.
    """
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    found = (
        ids.select(at.alias("at"))
        .groupBy((F.col("at") / 64).cast("long").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
        .toArrow()
    )
    held = np.zeros(bits // 64, np.int64)
    held[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            ok = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1
            yield batch.select([0, 1]).filter(pa.array(ok))

    return docs.where("doc_id is not null").select("doc_id", "text", at.alias("at")).mapInArrow(run, "doc_id long, text string")


def intersections(left: list[np.ndarray], right: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets on the left with sets on the right."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)

    def matrix(sets: list[np.ndarray], values: np.ndarray, lo: int, hi: int) -> np.ndarray:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, values)
        ok = (at >= lo) & (at < hi)
        ok[ok] = common[at[ok]] == values[ok]
        m = np.zeros((len(sets), hi - lo), np.float32)
        m[row[ok], at[ok] - lo] = 1
        return m

    for lo in range(0, len(common), slab):
        hi = min(lo + slab, len(common))
        out += matrix(left, lv, lo, hi) @ matrix(right, rv, lo, hi).T
    return out.astype(np.int64)


def _estimates(left: list[np.ndarray], right: list[np.ndarray], k: int) -> np.ndarray:
    """Similarity estimates of all pairs: values that both sketches hold, over the size of the union's sketch.

    A shared value above the end of the union's sketch counts, too; so an estimate is rather too high.
    """
    a, b = [s[:k] for s in left], [s[:k] for s in right]
    both = intersections(a, b)
    total = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    return both / np.maximum(np.minimum(total - both, k), 1)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int, k: int = K) -> np.ndarray:
    """Which pairs are linked: sketches first, and full sets for the rows and columns that have a candidate."""
    out = np.zeros((len(left), len(right)), bool)
    likely = _estimates(left, right, k) >= FLOOR * percent / 80
    rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
    if len(rows):
        a, b = [left[i] for i in rows], [right[i] for i in columns]
        both = intersections(a, b)
        union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
        out[np.ix_(rows, columns)] = (100 * both >= percent * union) & (both > 0)
    return out


def _forest(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the linked pairs join, one for each node at most."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(a)):
        for j in np.flatnonzero(pairs[i]):
            x, y = find(int(a[i])), find(int(b[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(a[i]), int(b[j])))
    return out


def _group_sets(group: pa.Table, shingle: int) -> list[np.ndarray]:
    """The sets of a group's texts."""
    rows, out = pa.record_batch([group.column("text").combine_chunks()], ["text"]), []
    for part in chunks(rows, "text"):
        h, first = shingle_sets(words(part.column(0), SPACED_LOWER), shingle)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def links(docs: DataFrame, reps: DataFrame, shingle: int = SHINGLE, percent: int = 80, k: int = K) -> DataFrame:
    """Rows (a, b): links whose components are those of all linked pairs of representatives (rep, n_shingles, keys)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    values = reps.select("rep", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    # by windows, as the rows need one shuffle and one sort then
    of_key = Window.partitionBy("key")
    listed = values.select("*", F.min("rep").over(of_key).alias("hub"), F.count("*").over(of_key).alias("m")).where("m > 1")
    listed = durable(listed)

    # short lists: pairs that share one and whose sketches are alike, put together to families
    short = listed.where(F.col("m") <= SHORT)
    candidates = short.select(F.col("rep").alias("doc_id")).distinct()
    sketches = durable(_sketches(_among(texts, candidates), shingle, k))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("s")), "a")
        both = both.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        union = F.least(F.lit(k), F.size("s") + F.size("t") - common)
        return both.where(common >= FLOOR * percent / 80 * union).select("a", "b").distinct()

    # first with the smallest member; pairs of which both are like it need no estimate, they are in its family
    of_hub = durable(alike(short.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()))
    like_hub = of_hub.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.lit(True).alias("near"))
    told = short.where("rep != hub").join(like_hub, ["hub", "rep"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    x, y = told.where("not near").alias("x"), told.alias("y")
    sizes = (F.col("x.size") * 100 >= F.col("y.size") * percent) & (F.col("y.size") * 100 >= F.col("x.size") * percent)
    once = (F.col("x.rep") < F.col("y.rep")) | (F.col("y.near") & (F.col("x.rep") != F.col("y.rep")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & once & sizes)
    others = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    families = components(of_hub.union(alike(others)))

    # long lists: everything in the group of the smallest member
    long = listed.where(F.col("m") > SHORT).where("rep != hub").select("hub", "rep")
    members = durable(long.union(families.select(F.col("component").alias("hub"), F.col("node").alias("rep"))).distinct())
    needed = members.select(F.col("rep").alias("doc_id")).union(members.select(F.col("hub").alias("doc_id"))).distinct()
    # texts of list members are shuffled, not their sets, which are larger
    own = _among(texts, needed).withColumnRenamed("doc_id", "rep")

    # step 1: each member against its hub
    parts = members.groupBy("hub").agg(F.ceil(F.count("*") / PART).alias("parts"))
    cut = members.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    of_hub = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = cut.select("hub", "part", "rep").union(of_hub.select("hub", "part", F.col("hub").alias("rep"))).join(own, "rep")

    def against_hub(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep = group.column("rep").to_numpy()
        hub = key[0].as_py()
        all_sets = _group_sets(group, shingle)
        head = [s for s, r in zip(all_sets, rep, strict=True) if r == hub]
        rest = [i for i, r in enumerate(rep) if r != hub]
        linked = linked_pairs([all_sets[i] for i in rest], head, percent, k).any(axis=1) if rest and head else np.zeros(len(rest), bool)
        return pa.table({"hub": pa.array([hub] * len(rest), pa.int64()), "rep": pa.array(rep[rest], pa.int64()), "linked": linked})

    stars = durable(first.groupBy("hub", "part").applyInArrow(against_hub, "hub long, rep long, linked boolean"))
    stars = stars.groupBy("hub", "rep").agg(F.max("linked").alias("linked"))

    # step 2: members without a link to the hub, against each other and the linked ones, in blocks
    sizes = stars.groupBy("hub").agg(
        F.ceil(F.sum((~F.col("linked")).cast("int")) / PART).alias("rows"), F.ceil(F.count("*") / PART).alias("columns"), F.count("*").alias("m")
    ).where("rows > 0 and m > 1")
    both = stars.join(sizes, "hub")
    rows = both.where("not linked").select(
        "hub", F.pmod(F.xxhash64("rep"), "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), "rep", F.lit(True).alias("left")
    )
    columns = both.select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), "columns").alias("j"), "rep", F.lit(False).alias("left")
    )
    second = rows.union(columns)
    # most groups have no such members: their texts are not shuffled again
    rest = _among(texts, second.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
    second = second.join(rest, "rep")

    def block_pair(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, left = group.column("rep").to_numpy(), group.column("left").to_numpy()
        all_sets = _group_sets(group, shingle)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        found = []
        if len(a) and len(b):
            pairs = linked_pairs([all_sets[i] for i in a], [all_sets[i] for i in b], percent, k)
            found = _forest(rep[a], rep[b], pairs)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    others = second.groupBy("hub", "i", "j").applyInArrow(block_pair, "a long, b long")
    return stars.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")).union(others)


def find(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = durable(_keyed(texts, shingle, percent))
    known = keyed.where("n_shingles > 0 and doc_id is not null")
    by_digest = known.groupBy("digest")
    reps = by_digest.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    copies = known.select("doc_id", "digest").join(by_digest.agg(F.min("doc_id").alias("rep")), "digest").where("doc_id != rep")
    edges = links(docs, reps, shingle, percent, k).union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    found = components(edges)
    joined = keyed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
