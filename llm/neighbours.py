"""Nearest neighbours through vantage-point trees, one per shard.

Index. Rows are dealt to shards of bounded size by a hash, whatever their values, so neither a vector that a third of
the rows share nor a dense region makes a shard large. In each shard the rows are halved again and again by
their distance from a vantage point, until ``LEAF`` are left; a node keeps the largest distance of its near half
and the smallest of its far half. Every row is in a leaf.

Search. Queries come in blocks; a block goes down the tree together. First each query visits the leaf it falls into, which gives
its radius: the distance of the k-th nearest found. Then a half is visited if the triangle inequality allows rows within
radius / ``factor`` there. Factor one is exact search; a larger one prunes more and may miss neighbours at the edge.
In a leaf, products give distances up to rounding, and all rows that may be within the radius are measured again as they are.

Scale. Queries go to every shard, as any row may be near: with q queries and s shards q * s vectors are shuffled. There are
at most 100 shards, or as many as keep one below ``SHARD_BYTES``, so for a hundredth of the rows as queries that is about the table itself
until shards reach that size. A shard's rows are streamed into its tree, the queries past it block by block: a task holds
one shard and one block. Each shard answers with k rows a query, and ranks come from a window with a limit.

Rows. Vectors that are null, empty, all zero, or hold a null, NaN or infinity take no part, nor do rows without an id (or with 2^63 - 1). Vectors
are compared with those of their own length only. Rows with the query's id are the query's own; each of several rows
with one id asks for itself, and repeated rows count one by one as neighbours. With fewer than k candidates all are found; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import durable

LEAF = 128
#: The fewest rows of a shard, if there are so many, and its most bytes as 32-bit numbers.
SHARD_ROWS = 4096
SHARD_BYTES = 64 << 20
BLOCK = 512
#: The most numbers gathered at once when pairs are measured.
NUMBERS = 1 << 22
FACTOR = 2.0


def measurable(vector: Column) -> Column:
    """Whether a vector takes part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of a and rows of b, pair by pair, squares being added in the order of the components."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x - y) ** 2
    return np.sqrt(total)


class Tree:
    """A vantage-point tree over rows of vectors, in the order of ``self.rows``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 5):
        self.rows = np.arange(len(vectors))
        self.vectors, self.ids = vectors, ids
        self.nodes: list[tuple] = []  # (vantage row, most of the near half, least of the far half, near, far) or (begin, end)
        self._random = np.random.default_rng(seed)
        self.root = self._build(0, len(vectors))
        # leaves are contiguous
        self.vectors, self.ids = vectors[self.rows], ids[self.rows]
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)

    def _build(self, begin: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append((begin, end))
        if end - begin > LEAF:
            own = self.rows[begin:end]
            vantage = self.vectors[own[self._random.integers(len(own))]]
            away = np.sqrt(((self.vectors[own] - vantage) ** 2).sum(axis=1))
            half = len(own) // 2
            order = np.argpartition(away, half)
            self.rows[begin:end] = own[order]
            most, least = away[order[:half]].max(), away[order[half:]].min()
            near = self._build(begin, begin + half)
            far = self._build(begin + half, end)
            self.nodes[at] = (vantage, most, least, near, far)
        return at

    def search(self, asked: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest of each query, nearest first, ties to smaller ids; distance infinity: none."""
        best_id = np.full((len(asked), k), np.iinfo(np.int64).max)
        best = np.full((len(asked), k), np.inf)
        squares = np.einsum("ij,ij->i", asked, asked)
        home = np.full(len(asked), -1)

        def from_vantage(node: tuple, who: np.ndarray) -> np.ndarray:
            return np.sqrt(((asked[who] - node[0]) ** 2).sum(axis=1))

        def leaf(begin: int, end: int, who: np.ndarray) -> None:
            rows = self.vectors[begin:end]
            scale = squares[who][:, None] + self.squares[None, begin:end]
            rough = scale - 2 * (asked[who] @ rows.T)
            radius = best[who, -1]
            # NaN, from overflow, counts as within
            within = ~(rough > (radius**2)[:, None] + 1e-9 * scale) & (self.ids[None, begin:end] != own[who][:, None])
            i, j = np.nonzero(within)
            if not len(i):
                return
            exact = np.full(within.shape, np.inf)
            step = max(1, NUMBERS // rows.shape[1])
            for part in (slice(at, at + step) for at in range(0, len(i), step)):
                exact[i[part], j[part]] = distances(asked[who[i[part]]], rows[j[part]])
            hit = np.unique(i)
            ids = np.where(within[hit], np.broadcast_to(self.ids[begin:end], (len(hit), end - begin)), np.iinfo(np.int64).max)
            d = np.concatenate((best[who[hit]], exact[hit]), axis=1)
            n = np.concatenate((best_id[who[hit]], ids), axis=1)
            order = np.lexsort((n, d), axis=-1)[:, :k]
            best[who[hit]] = np.take_along_axis(d, order, axis=1)
            best_id[who[hit]] = np.take_along_axis(n, order, axis=1)

        def go_home(at: int, who: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 2:
                home[who] = at
                leaf(*node, who)
                return
            near = from_vantage(node, who) <= (node[1] + node[2]) / 2
            for side, some in ((node[3], who[near]), (node[4], who[~near])):
                if len(some):
                    go_home(side, some)

        def visit(at: int, who: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 2:
                who = who[home[who] != at]
                if len(who):
                    leaf(*node, who)
                return
            d = from_vantage(node, who)
            for side, gap in ((node[3], d - node[1]), (node[4], node[2] - d)):
                some = who[~(gap * factor > best[who, -1] + 1e-9 * d)]
                if len(some):
                    visit(side, some)

        if len(asked):
            go_home(self.root, np.arange(len(asked)))
            visit(self.root, np.arange(len(asked)))
        return best_id, best


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, vector) and (query_id, vector): for each query its k nearest rows."""
    rows = rows.where(F.col("vec_id").isNotNull() & measurable(F.col("vector")))
    queries = queries.where(F.col("query_id").isNotNull() & measurable(F.col("vector")))
    if shards is None:
        n, numbers = rows.agg(F.count("*"), F.sum(F.size("vector").cast("long"))).first()
        shards = max(1, math.ceil(4 * (numbers or 0) / SHARD_BYTES), min(100, math.ceil(n / SHARD_ROWS)))
    length = F.size("vector")
    # a query's number tells rows with one id apart
    asked = durable(queries.select(F.monotonically_increasing_id().alias("number"), "query_id", "vector"))
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    stored = rows.select(
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"), length.alias("length"), F.lit(-1).cast("long").alias("number"), F.col("vec_id").alias("id"), "vector"
    )
    sent = asked.select(all_shards.alias("shard"), length.alias("length"), "number", F.col("query_id").alias("id"), "vector")
    # of each shard and length first the rows, then the queries
    stream = stored.union(sent).repartition(shards, "shard", "length").sortWithinPartitions("shard", "length", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            for part in _runs(batch):
                key = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if key != now:
                    now, held, tree = key, [], None
                ids = part.column(3).to_numpy()
                if part.column(2)[0].as_py() < 0:
                    held.append((_matrix(part.column(4)), ids))
                    continue
                if tree is None and held:
                    tree = Tree(np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held]))
                    held = []
                for begin in range(0, len(ids) if tree else 0, BLOCK):
                    some = part.slice(begin, BLOCK)
                    own = ids[begin : begin + BLOCK]
                    found, score = tree.search(_matrix(some.column(4)), own, k, factor)
                    who, place = np.nonzero(np.arange(k)[None, :] < (found != np.iinfo(np.int64).max).sum(axis=1)[:, None])
                    yield pa.record_batch(
                        [some.column(2).take(pa.array(who)), pa.array(own[who]), pa.array(found[who, place]), pa.array(score[who, place])],
                        ["number", "query_id", "vec_id", "score"],
                    )

    found = stream.mapInArrow(run, "number long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("number").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one shard and length, rows and queries apart."""
    keys = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy() < 0]
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(begin, end - begin)


def find(rows: DataFrame, every: int = 100, k: int = 10, factor: float = FACTOR, vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose vec_id ``every`` divides, among all rows but those of its own id."""
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    queries = named.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return search(named, queries, k, factor)
