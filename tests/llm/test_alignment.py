"""Token alignment against brute force with the files' own libraries."""

import collections
import hashlib
import random

import pytest

from llm import alignment

SCHEMA = "doc_id long, text string, chunk long, a string, pair long, count long"


def documents():
    rng = random.Random(2)
    words = ["the", "Straße", "naïve", "x1y22", "日本語", "don't", "<|endoftext|>", "<s>", "\n\n", "  two", "\t", "🙂", "http://a.b/c", "ñandú", "antidisestablishment"]
    texts = [None, "", " ", "a", "▁ sign", "ends with space ", "é", "\x00zero"]
    texts += [rng.choice([" ", "", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts.append("many words of plain text and some 12345 numbers, " * 6000)
    rows = [(i, t) for i, t in enumerate(texts)]
    return [(i, t, 1, "x", 2, 3) for i, t in [*rows, rows[10], (None, "null id"), (3, "shared id")]]


@pytest.fixture(scope="module")
def encoders():
    folder = alignment.Path(alignment.TOKENIZERS)
    return alignment.Encoders((folder / "byte_bpe_50k.json").read_text(), (folder / "piece_bpe_32k.model").read_bytes())


@pytest.fixture(scope="module")
def slow():
    """The json file by its own library, whole texts."""
    from tokenizers import Tokenizer

    it = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    it.encode_special_tokens = True
    return it


def ids(text, slow, known):
    if not text:
        return [], []
    a, b = slow.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    whole = (" " + text).encode()
    signs = alignment.byte_of_sign()
    joined = b"".join(bytes(signs[c] for c in slow.id_to_token(i)) for i in a)
    return (a, b) if joined == whole == b"".join(known.bytes_b[i] for i in b) else ([], [])


def brute(a, b, known):
    """Groups spelled out, and links, by walking over bytes."""
    ends_a, ends_b, at = [], [], 0
    for i in a:
        at += len(known.bytes_a[i])
        ends_a.append(at)
    at = 0
    for i in b:
        at += len(known.bytes_b[i])
        ends_b.append(at)
    groups, links = [], []
    cuts = sorted(set(ends_a) & set(ends_b))
    before = 0
    for cut in cuts:
        groups.append(",".join(str(i) for i, e in zip(a, ends_a, strict=True) if before < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if before < e <= cut))
        before = cut
    for i, e, s in zip(a, ends_a, [0, *ends_a], strict=False):
        links += [(i, j) for j, f, t in zip(b, ends_b, [0, *ends_b], strict=False) if t < e and s < f]
    return groups, links


def test_find(spark, slow, encoders):
    rows = [r for r in documents() if len(r[1] or "") < 100_000]
    found = alignment.find(spark.createDataFrame(rows, SCHEMA)).collect()
    held = [(i, *ids(t, slow, encoders)) for i, t, *_ in rows]
    parts = [brute(a, b, encoders) for _, a, b in held]
    count = collections.Counter(p for _, links in parts for p in set(links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = collections.Counter()
    for (i, a, b), (groups, links) in zip(held, parts, strict=True):
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        want[i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest] += 1
    assert collections.Counter(tuple(r) for r in found) == want
    assert sum(1 for _, a, _ in held if not a) >= 3  # null, empty and texts that come to other bytes


def test_long_texts_are_encoded_in_pieces(slow, encoders):
    text = documents()[88][1]
    assert len(text) > 4 * alignment.PIECE
    assert len(list(alignment._pieces(text))) > 3
    assert tuple(x.tolist() for x in encoders.encode(text)) == ids(text, slow, encoders)


def test_pieces_of_b_hold_no_space_but_in_front(encoders):
    assert not any(b" " in x.lstrip(b" ") for x in encoders.bytes_b)


def test_empty(spark):
    assert alignment.find(spark.createDataFrame([], SCHEMA)).collect() == []
    got = alignment.find(spark.createDataFrame([(5, None, 1, "", 1, 1)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n_b", [9, 1 << 31])
def test_documents_of_pairs_are_counted_in_one_sort(n_b):
    """Also where pair and document do not fit in one number; ids of any size."""
    np, rng = alignment.np, random.Random(n_b)
    rows = sorted((rng.randrange(12), rng.randrange(7), rng.randrange(9)) for _ in range(3000))
    doc, a, b = (np.array(x, np.int64) for x in zip(*rows))
    ids, n = alignment.document_counts(doc, a << 32 | b, n_b)
    want = collections.Counter((x, y) for _, x, y in set(rows))
    assert [(i >> 32, i & 0xFFFFFFFF, k) for i, k in zip(ids.tolist(), n.tolist())] == [(*p, want[p]) for p in sorted(want)]
    none = np.empty(0, np.int64)
    assert [len(x) for x in alignment.document_counts(none, none, n_b)] == [0, 0]


def test_groups_are_told_once_and_spelled_from_them():
    """Random tokens over several documents, one without any; one component spans hundreds of tokens."""
    np, rng = alignment.np, random.Random(4)
    cuts = lambda: np.diff([0, *sorted(rng.sample(range(1, 150), 60)), 150]).tolist()
    sizes = [[cuts(), cuts()], [[], []], [[2] * 300, [1, *[2] * 299, 1]]]
    assert all(sum(a) == sum(b) for a, b in sizes)
    flat = [[n for doc in sizes for n in doc[k]] for k in (0, 1)]
    ids = [np.array([rng.randrange(50) for _ in x], np.int32) for x in flat]
    t = alignment.Tokens(*[np.array([len(doc[k]) for doc in sizes], np.int64) for k in (0, 1)], *ids, *[np.cumsum(x) for x in flat])
    told = t.groups()
    known = type("Known", (), {"bytes_a": [b"x" * n for n in flat[0]], "bytes_b": [b"x" * n for n in flat[1]]})
    spelled, links, at = [], [], [0, 0]
    for doc, parts in enumerate(sizes):
        places = [list(range(x, x + len(p))) for x, p in zip(at, parts)]
        at = [x + len(p) for x, p in zip(at, parts)]
        groups, pairs = brute(*places, known)
        spelled.append(";".join("|".join(",".join(str(ids[k][int(i)]) for i in side.split(",")) for k, side in enumerate(g.split("|"))) for g in groups))
        links += [(doc, int(ids[0][i]) << 32 | int(ids[1][j])) for i, j in pairs]
    assert alignment.spelled_groups(t, *told) == spelled
    assert [*zip(*(x.tolist() for x in t.links()))] == links
    none = alignment.Tokens(*[np.zeros(2, np.int64)] * 2, *[np.empty(0, np.int32)] * 2, *[np.empty(0, np.int64)] * 2)
    assert alignment.spelled_groups(none, *none.groups()) == ["", ""] and not len(none.links()[0])
