"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm import variants

SCHEMA = "doc_id long, text string, word string, n string, key long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    rng = random.Random(9)
    letters = "abcdeéÀ÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "12 34 - _"), (3, "日本語 aaaaa ÿÿÿÿÿ ĀĀĀĀĀ")]
    for i in range(4, 120):
        chosen = [rng.choice(stems) for _ in range(rng.randint(1, 200))]
        for at in range(0, len(chosen), 3):
            w, p = chosen[at], rng.randrange(len(chosen[at]))
            chosen[at] = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p:], w.upper()])
        rows.append((i, rng.choice([" ", ", ", "\n1"]).join(chosen)))
    rows.append((150, "chainaaaa " * 4 + "chainaaab " * 12 + "chainaabb " * 40 + "chainabbb " * 200))
    long = "abc" * 20000
    rows += [(200, long), (201, long + "d"), (202, long), (203, f"{long} {long}d {long}d"), (None, "nullid " * 40), rows[20], rows[20]]
    return [(i, t, "x", "y", 1) for i, t in rows]


def brute(rows):
    count = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) != 1:
            return False
        p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return b[:p] + b[p + 1 :] == a

    out, form = {}, {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(others), form[w], n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


def test_find(spark):
    rows = documents()
    found = variants.find(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in found.collect()}
    want = brute(rows)
    assert got == want
    assert sum(1 for v in want.values() if v[2]) > 20
    assert any(v[4] != v[2] for v in want.values() if v[2])  # a chain


def test_empty(spark):
    assert variants.find(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants.find(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).collect() == []


@pytest.mark.parametrize("share", [0, 0.5])
def test_no_edit_alters_more_grams_than_the_bound(share):
    rng = random.Random(3)
    letters = "abcé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(300)]
    split = np.random.default_rng(1).random(variants.CHARS**2) < share

    def grams(word):
        (_, rows), = variants.coded(pa.array([word]))
        gram, end, kept = variants.decompose(rows, split)
        size = rows.shape[1]
        bound = int(variants.affected(rows, split, end, kept)[0])
        return [(int(gram[0, p]), p, size - int(end[0, p])) for p in np.flatnonzero(kept[0])], bound

    for word in words:
        own, bound = grams(word)
        assert bound < len(own)  # some gram is always kept
        p = rng.randrange(len(word))
        for other in (word[:p] + word[p + 1 :], word[:p] + "z" + word[p:], word[:p] + "z" + word[p + 1 :], word + "z"):
            theirs, _ = grams(other)
            left, right = {(g, a) for g, a, _ in theirs}, {(g, b) for g, _, b in theirs}
            assert sum((g, a) not in left and (g, b) not in right for g, a, b in own) <= bound
