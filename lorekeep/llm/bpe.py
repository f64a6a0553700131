"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the tokenizer's pattern; each piece that is a token by itself is that token, any other is merged from
its bytes. The merges of a piece wait in buckets, one per merge rank, which hold places in a linked list of parts; a bitmap of two levels tells the
non-empty buckets, so that find-first-set gives the next rank in two steps however long the piece is. Entries that a merge made
stale are skipped when they come up. A piece of n bytes takes O(n log n) at most, which matters for very long pieces.

Edge cases. A null or empty text has no ids, and decodes to no bytes. Special tokens' strings are ordinary text.
Repeated rows give repeated rows; an empty table gives none; extra columns do not take part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import keeps

#: Pieces kept with their ids in a worker, in two generations of so many, 0.1 GB each; a full young one takes the old one's place.
MEMO_PIECES = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: a line for each token, its bytes in base64 and its rank."""
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


#: Bits of a rank that the lower level of the bitmap tells apart.
LOW = 8


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece. The queue (bitmap of two levels, buckets by rank) is written out here, as this is the inner loop."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))  # where the part before it begins
    pair = [-1] * n  # rank of the part here with the next one; -1: none, or no part begins here
    buckets: dict[int, list[int]] = {}  # places by rank, leftmost first
    words: dict[int, int] = {}  # lower level: bits of the non-empty buckets
    top = 0  # upper level: bits of the words that are not zero
    fresh = [(i, get(piece[i : i + 2])) for i in range(n - 1)]
    while True:
        for i, rank in fresh:
            if rank is None:
                pair[i] = -1
                continue
            pair[i] = rank
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [i]
                high = rank >> LOW
                words[high] = words.get(high, 0) | 1 << (rank & (1 << LOW) - 1)
                top |= 1 << high
            else:
                heappush(bucket, i)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            bit = word & -word
            rank = (high << LOW) + bit.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = word = word ^ bit
                if not word:
                    top ^= 1 << high
            if pair[i] == rank:  # else stale
                break
        else:
            break
        j = after[i]
        end = after[i] = after[j]
        pair[j] = pair[i] = -1
        left = before[i]
        fresh = []
        if end < n:
            before[end] = i
            fresh.append((i, get(piece[i : after[end]])))
        if left >= 0:
            fresh.append((left, get(piece[left:end])))
    ids, i = [], 0
    while i < n:
        end = after[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return tuple(ids)


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        young, ids = self.young, []
        known = young.get
        for piece in self.pieces(text):
            got = known(piece)
            if got is None:
                got = self.old.get(piece)
                if got is None:
                    got = merge(piece.encode(), self.ranks)
                if len(piece) <= 64:
                    young[piece] = got
            ids += got
        if len(young) >= MEMO_PIECES:
            self.old, self.young = young, {}
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(data: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key, codecs = hashlib.sha1(data + pattern.encode()).digest(), keeps("bpe")
    if key not in codecs:
        codecs[key] = Codec(data, pattern)
    return codecs[key]


def _batches(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch, some MB at a time."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(i.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) for each row of docs. data: the rank file, under a MB for the vocabularies here; it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            for ids, texts in _batches(batch):
                coded = [c.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(coded, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, data: bytes, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and decoded (binary) for each row of coded (id, ids)."""
    shared = coded.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            out = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, data: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encode, then decode, in one pass over the rows: keep, n_tokens, ids_sha256, decoded_sha256. Ids live for one text at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(data)
    n = len(keep)

    def run(batches):
        c = codec(shared.value, pattern)
        shown = {rank: str(rank) for rank in c.bytes_of}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            counts, coded, back = [], [], []
            for text in batch.column(n):
                ids = c.encode(text.as_py() or "")
                counts.append(len(ids))
                coded.append(sha(" ".join(map(shown.__getitem__, ids)).encode()))
                back.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(counts, pa.int64()), pa.array(coded), pa.array(back)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")
