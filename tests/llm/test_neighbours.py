"""Nearest neighbours against exact search."""

import numpy as np
import pytest

from llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, rank string, score string"


def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 8))).astype(np.float32)
    x[100:400] = x[100]  # one vector in a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [None] + [1.0] * 7), (1400, [float("nan")] * 8), (1500, [float("inf")] + [1.0] * 7)]
    rows += [(None, [1.0] * 8), (1600, [1.0, 2.0]), (1601, [1.0, 3.0]), (200, x[5].tolist()), (7, x[7].tolist()), (-100, x[9].tolist())]
    return [(i, v, 0, 0, "r", "s") for i, v in rows]


def brute(rows, k=10):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, v in kept:
        if q % 100 == 0:
            near = sorted((float(neighbours.distances(v[None], w[None])[0]), i) for i, w in kept if i != q and len(w) == len(v))
            out.append((q, [(i, d) for d, i in near[:k]]))
    return sorted(out)


def asked(frame):
    """The answers, list by list: rows that share an id give lists that share it."""
    lists = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"], r.score, r.vec_id)):
        lists.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, r.score))
    return lists


@pytest.mark.parametrize("shards", [1, 5])
def test_factor_one_is_exact(spark, shards, monkeypatch):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "shard")
    named = frame.withColumnRenamed("embedding", "vector")
    got = asked(neighbours.search(named, named.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10, 1.0, shards))
    want = {}
    for q, near in brute(rows):
        for rank, x in enumerate(near, 1):
            want.setdefault((q, rank), []).append(x)
    assert got == {k: sorted(v, key=lambda x: (x[1], x[0])) for k, v in want.items()}


def test_find(spark):
    rows = vectors()
    found = neighbours.find(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows)
    hits = sum(len(got[q] & {i for i, _ in near}) for q, near in want if q != 200)
    assert hits >= 0.9 * sum(len(near) for q, near in want if q != 200)
    assert got[1600] == {1601}
    assert not {1000, 1100, 1200, 1300, 1400, 1500} & set(got)


def test_pruning_saves_work_and_factor_one_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 6))
    tree = neighbours.Tree(x, np.arange(6000))
    q = x[:50]
    away = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    away[np.arange(50), np.arange(50)] = np.inf
    want = np.argsort(away, axis=1)[:, :10]
    assert (tree.search(q, np.arange(50), 10, 1.0)[0] == want).all()
    seen = {}
    for factor in (1.0, 2.0):
        tree.squares = Counting(tree.squares)
        tree.search(q, np.arange(50), 10, factor)
        seen[factor] = tree.squares.rows
        tree.squares = tree.squares.values
    assert seen[2.0] <= seen[1.0] < 6000 * 50 / 2


class Counting:
    """Counts the leaves' rows that are read, at least once for any query."""

    def __init__(self, values):
        self.values, self.rows = values, 0

    def __getitem__(self, key):
        out = self.values[key]
        self.rows += out.size
        return out


def test_empty(spark):
    assert neighbours.find(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.find(spark.createDataFrame([(100, [1.0], 0, 0, "", "")], SCHEMA)).collect() == []
