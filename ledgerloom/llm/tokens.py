"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

A segment tree over the byte positions of a pre-token stores the least pair rank with its leftmost position at
the root. Every merge takes the root, joins two live neighbours and updates the two pairs beside them, each in
logarithmic time, so that even one pre-token of a million bytes takes n log n steps. Distinct pre-tokens repeat
a lot; each task keeps the ids of the last ones in a bounded memory.

Edge cases, all defined: null and empty texts give an empty list; blanks are encoded as they stand; special
tokens' strings are ordinary text; lone surrogates are encoded as the replacement character; repeated rows are
kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import spread

#: Fixed value: how the public vocabulary splits text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Entries and bytes up to which a pre-token is remembered.
MEMORY, MEMORABLE = 200_000, 64
NONE = 1 << 62


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # where the live symbol that begins at a position ends
    before = list(range(-1, n - 1))  # where the live symbol before it begins

    def key(i: int) -> int:
        j = end[i]
        r = ranks.get(piece[i : end[j]]) if j < n else None
        return NONE if r is None else r * n + i

    for i in range(n - 1):
        tree[size + i] = key(i)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, v: int) -> None:
        i += size
        if tree[i] == v:
            return
        tree[i] = v
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    while (root := tree[1]) != NONE:
        i = root % n
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        if j < n - 1:
            put(j, NONE)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Packed(dict):
    """The ids of each pre-token as packed 32-bit integers; short ones are kept up to a fixed number of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace") if not _lone(piece) else piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
        ids = array("i", merge(raw, self.ranks)).tobytes()
        if len(raw) <= MEMORABLE:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts: pre-tokens are split off, looked up and joined without a step of Python for each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.split, self.known = regex.compile(pattern).findall, Packed(ranks)

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text))) if text else b""

    def __call__(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


def _lone(piece: str) -> bool:
    return any("\ud800" <= c <= "\udfff" for c in piece)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document. The vocabulary, fixed at about a megabyte, is read once and broadcast."""
    raw = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator):
        import pyarrow as pa

        encoder = Encoder(parse_ranks(raw.value))
        for b in batches:
            texts = [encoder.packed(t) for t in b.column("text").to_pylist()]
            ends = pa.array([0, *accumulate(len(t) // 4 for t in texts)], pa.int32())
            flat = pa.Array.from_buffers(pa.int32(), sum(map(len, texts)) // 4, [None, pa.py_buffer(b"".join(texts))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>")
