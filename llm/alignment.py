"""Alignment of the tokens of two tokenizers over the same bytes.

Tokens. A reads space + text, B the text, to which it adds the space itself; both come to the same bytes, or the document
has no tokens. The files' vocabularies are read on the driver and broadcast (2 MB, fixed); special tokens' strings are
plain text. A's merges run in the order of its ids, so its vocabulary is all that its fast encoder needs. Long texts
are encoded in pieces, cut before a space between two ASCII letters, which no token of either crosses.

Groups. In a chunk of documents every token points to its farthest-right overlapping token: an A token to the B token that holds
its last byte, a B token to the A token, and an A token that ends where a B token does to itself. Each pointer is then
replaced by its target's pointer, all at once, until nothing moves: every token has its component's terminal token, in as many steps as
the logarithm of the longest component.

Counts. A link is a pair of overlapping tokens; a pair of ids counts the documents that hold it linked. Each chunk adds
its documents up, so a pair is one row a chunk; the corpus-wide counts, and whether a count is its A id's highest, come back to the
chunks by a join, and meet the chunk's tokens there.

Scale. Texts are encoded once; kept are the ids, in files that executors share. Shuffled are the pairs of each chunk
(``CHUNK`` bytes of text) and the compressed ids. A row holds one chunk: some 2 MB, or a document, if that is longer. The most frequent pair has
one row a chunk, and an A id no more pairs than B has ids.

Rows. Null and empty texts, and those that come to other bytes, have zeros and an empty digest. A null doc_id stays null.
Repeated rows count one by one, rows with one doc_id are documents of their own. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import durable
from llm.words import chunks

TOKENIZERS = "/opt/tokenizers"
CHUNK = 2 << 20
#: Characters of a text that are encoded at once.
PIECE = 1 << 16

# The split pattern of A's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as a printable character: itself, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoders:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        import sentencepiece
        import tiktoken

        said = json.loads(byte_bpe)
        special = {t["id"] for t in said.get("added_tokens", [])}
        signs = byte_of_sign()
        ranks = {bytes(signs[c] for c in token): i for token, i in said["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and B; none if either comes to other bytes than space + text."""
        none = np.empty(0, np.int32)
        if not text:
            return none, none
        parts_a, b = [none], []
        for at, piece in _pieces(text):
            parts_a.append(self.a.encode_to_numpy(piece if at else " " + piece, disallowed_special=()).astype(np.int32))
            b += self.b.encode(piece[1:] if at else piece)
        a = np.concatenate(parts_a)
        whole = b" " + text.encode()
        # A's tokens are pieces of the bytes themselves, so their length tells
        same = self.sizes_a[a].sum() == len(whole) and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        return (a, np.array(b, np.int32)) if same else (none, none)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Where each piece starts, and the piece; all but the first begin with the space they are cut at."""
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


@dataclass
class Tokens:
    """The tokens of a chunk of documents, one after the other."""

    n_a: np.ndarray  # tokens of each document
    n_b: np.ndarray
    a: np.ndarray  # ids
    b: np.ndarray
    end_a: np.ndarray  # where tokens end, in bytes of the whole chunk
    end_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The document and the pair of ids (A's in the upper 32 bits) of every link, by A token."""
        if not len(self.a):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ended = _ended(self.end_b)
        first = ended[np.concatenate(([0], self.end_a[:-1]))]
        count = ended[self.end_a - 1] - first + 1
        upto = np.concatenate(([0], np.cumsum(count)))
        other = np.arange(upto[-1]) + np.repeat(first - upto[:-1], count)
        of_doc = np.diff(upto[np.concatenate(([0], np.cumsum(self.n_a)))])
        return np.repeat(np.arange(len(self.n_a)), of_doc), np.repeat(self.a.astype(np.int64) << 32, count) | self.b[other]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each A token's and each B token's group, in order over the chunk."""
        n = len(self.a)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        holds_a = _ended(self.end_b)[self.end_a - 1]
        to_right = np.where(self.end_b[holds_a] > self.end_a, n + holds_a, np.arange(n))
        pointer = np.concatenate((to_right, _ended(self.end_a)[self.end_b - 1]))
        moving = np.arange(len(pointer))
        while len(moving):
            # all at once: read before any is written; one that has come to a terminal stays there
            further = pointer[pointer[moving]]
            moved = further != pointer[moving]
            moving = moving[moved]
            pointer[moving] = further[moved]
        number = np.cumsum(pointer[:n] == np.arange(n)) - 1
        number = number[pointer]
        return number[:n], number[n:]


def _ended(ends: np.ndarray) -> np.ndarray:
    """For every offset, how many tokens end there or before: looked up, where a search would take a step a bit."""
    return np.cumsum(np.bincount(ends))


def packed(ids: list[np.ndarray]) -> bytes:
    """Ids as 32-bit numbers, compressed: they are written twice, to files and in a shuffle."""
    return pa.Codec("zstd", compression_level=3).compress(np.concatenate([np.empty(0, np.int32), *ids]).tobytes(), asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=4 * n), np.int32)


def tokens(row: dict, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Tokens:
    a, b = unpacked(row["a"], sum(row["n_a"])), unpacked(row["b"], sum(row["n_b"]))
    return Tokens(np.array(row["n_a"], np.int64), np.array(row["n_b"], np.int64), a, b, np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b]))


def spelled_groups(t: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """Of each document ``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group."""
    # groups follow each other: A's tokens stand behind B's of earlier groups, B's behind A's of their own
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    in_a, in_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n)))) for g in (group_a, group_b))
    ids = np.empty(len(group_a) + len(group_b), np.int64)
    mark = np.zeros(len(ids), np.int64)  # a comma, or what ends A's tokens or the group
    ids[np.arange(len(t.a)) + in_b[group_a]] = t.a
    ids[np.arange(len(t.b)) + in_a[group_b + 1]] = t.b
    mark[in_a[1:] + in_b[:-1] - 1] = 1
    mark[in_a[1:] + in_b[1:] - 1] = 2
    if not len(ids):
        return [""] * len(t.n_a)
    # an Arrow array of texts holds them one after the other
    names = _marked_ids(1 << int(ids.max()).bit_length())
    _, ends, text = names.take(pa.array(ids * 3 + mark)).buffers()
    cuts = np.frombuffer(ends, np.int64)[np.concatenate(([0], np.cumsum(t.n_a + t.n_b)))]
    text = text.to_pybytes()
    return [text[x : max(x, y - 1)].decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _marked_ids(n: int) -> pa.Array:
    """Each id below n with each mark behind it."""
    return pa.array([f"{i}{m}" for i in range(n) for m in ",|;"], pa.large_string())


def document_counts(doc: np.ndarray, pair: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of ids in order, B's ids being below n_b, and how many documents hold each."""
    short = (pair >> 32) * n_b + (pair & 0xFFFFFFFF)
    if len(pair) and max(int(short.max()), int(doc.max())) >= 1 << 31:
        short = np.unique(pair)
        each = np.unique(np.searchsorted(short, pair) << 32 | doc)
        return short, np.bincount(each >> 32, minlength=len(short))
    # pair and document in one number: sorted once
    each = np.sort(short << 32 | doc)
    each = each[np.concatenate(([True], each[1:] != each[:-1]))[: len(each)]] >> 32
    first = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1]))[: len(each)])
    return each[first] // n_b << 32 | each[first] % n_b, np.diff(np.append(first, len(each)))


ENCODED = "chunk long, doc_id array<long>, n_a array<int>, n_b array<int>, a binary, b binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def encode(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """One row a chunk of documents (doc_id, text): their ids, and the tokens of A and B as 32-bit numbers."""
    files = docs.sparkSession.sparkContext.broadcast((Path(byte_bpe).read_text(), Path(pieces).read_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, number = Encoders(*files.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                both = [encoders.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "chunk": number,
                            "doc_id": part.column(0).to_pylist(),
                            "n_a": [len(x) for x, _ in both],
                            "n_b": [len(y) for _, y in both],
                            "a": packed([x for x, _ in both]),
                            "b": packed([y for _, y in both]),
                        }
                    ],
                    pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int32())), ("n_b", pa.list_(pa.int32())), ("a", pa.binary()), ("b", pa.binary())]),
                )
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def align(encoded: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """One row a document, of encoded chunks that are read from files."""
    known = Encoders(Path(byte_bpe).read_text(), Path(pieces).read_bytes())
    sizes = encoded.sparkSession.sparkContext.broadcast((known.sizes_a, known.sizes_b))

    def pairs_of_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, pair = tokens(row, *sizes.value).links()
                ids, n = document_counts(doc, pair, len(sizes.value[1]))
                yield pa.record_batch([pa.array(np.full(len(ids), row["chunk"])), pa.array(ids), pa.array(n)], ["chunk", "pair", "n"])

    # made twice, which costs less than to keep them: to count, and to be looked up
    held = encoded.mapInArrow(pairs_of_chunk, "chunk long, pair long, n long")
    counts = durable(held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("id_a", F.shiftright("pair", 32)))
    highest = counts.groupBy("id_a").agg(F.max("count").alias("most"))
    counts = counts.join(highest, "id_a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    found = held.select("chunk", "pair").join(counts, "pair")

    def of_chunk(chunk: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():  # one
            t = tokens(row, *sizes.value)
            doc, pair = t.links()
            pairs = known.column("pair").to_numpy()
            order = np.argsort(pairs)
            at = order[np.searchsorted(pairs[order], pair)] if len(pair) else np.empty(0, np.int64)
            n = len(t.n_a)
            total = lambda values: pa.array(np.bincount(doc, values, n).astype(np.int64)) if len(doc) else pa.array(np.zeros(n, np.int64))  # noqa: B023, E731
            group, group_b = t.groups()
            ends = np.concatenate(([0], np.cumsum(t.n_a)))
            before = np.concatenate(([0], group + 1))[ends]  # groups up to the end of each document
            texts = spelled_groups(t, group, group_b)
            digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts]
            count = known.column("count").to_numpy()[at]
            best = known.column("best").to_numpy(zero_copy_only=False)[at]
            columns = [pa.array(row["doc_id"], pa.int64()), pa.array(t.n_a), pa.array(t.n_b), pa.array(np.diff(before)), total(None), total(best.astype(np.float64)), _exact_sums(doc, count, n), pa.array(digest, pa.string())]
            out.append(pa.Table.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")]))
        return pa.concat_tables(out)

    return encoded.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(of_chunk, RESULT)


def _exact_sums(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Sums by document in whole numbers; ``doc`` is in order."""
    total = np.concatenate(([0], np.cumsum(values.astype(np.int64))))
    cuts = np.searchsorted(doc, np.arange(n + 1))
    return pa.array(total[cuts[1:]] - total[cuts[:-1]])


def find(docs: DataFrame, folder: str = TOKENIZERS, byte_bpe: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    paths = f"{folder}/{byte_bpe}", f"{folder}/{pieces}"
    return align(durable(encode(docs, *paths)), *paths)
