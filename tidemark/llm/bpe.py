"""Byte-level BPE by ranks: a segment tree over byte positions holds the leftmost least pair rank.

Each merge takes the root's pair, joins it with its right neighbour and updates three leaves, so a piece
of n bytes takes O(n log n). A text is cut by the pattern first; pieces repeat, and a bounded cache
keeps the ids of those seen.

Defined cases: null and empty texts have no tokens; bytes missing from the ranks raise KeyError; of pairs of
equal rank the leftmost is merged first; a very long text, or piece, is encoded whole; repeated rows are each
encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

_NONE = 1 << 62
#: Pieces that each of a worker's two generations remembers.
CACHED = 150_000
_PACK = [struct.Struct(f"<{k}I") for k in range(65)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by repeatedly joining the leftmost pair of least rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n == 0:
        return []
    width = 1 << max(0, (n - 2).bit_length())
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i  # one number: rank first, then position
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.get
    while (top := tree[1]) != _NONE:
        at = top % n
        right = after[at]
        end = after[right]
        after[at] = end
        here = there = _NONE
        if end < n:
            before[end] = at
            rank = get(piece[at : after[end]])
            if rank is not None:
                here = rank * n + at
        left = before[at]
        if left >= 0:
            rank = get(piece[left:end])
            if rank is not None:
                there = rank * n + left
        for i, value in ((right, _NONE), (at, here), (left, there)):
            if i < 0 or i >= width:
                continue
            i += width
            if tree[i] == value:
                continue
            tree[i] = value
            while i > 1:  # the lesser of two siblings goes up, until nothing changes
                beside = tree[i ^ 1]
                if beside < value:
                    value = beside
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class _Ids(dict):
    """Packed little-endian ids by piece, in two generations: what the old one still serves is kept."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = merge(piece.encode(), self.ranks)
            ids = _PACK[len(found)].pack(*found) if len(found) < len(_PACK) else np.array(found, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ids = _Ids(ranks)
        self.pieces = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = self.ids
        return b"".join([ids[m] for m in self.pieces.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LAST: list[Codec] = []


def shared_codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The worker's codec; a reused worker process goes on with the pieces it has seen."""
    if not _LAST or _LAST[0].ids.ranks != ranks or _LAST[0].pieces.pattern != pattern:
        _LAST[:] = [Codec(ranks, pattern)]
    return _LAST[0]


def tokenize(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (packed) and the bytes decoded from them, per row."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def row(codec, k, t):
        ids = codec.encode(t or "")
        return k, len(ids) // 4, ids, codec.decode(ids)

    return map_rows(df.select(key, text), _with_codec(df, path, pattern, row), schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and the digests of ids and decoded bytes, without carrying either out of the task."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(codec, k, t):
        ids = codec.encode(t or "")
        return k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return map_rows(df.select(key, text), _with_codec(df, path, pattern, row), schema)


def _with_codec(df: DataFrame, path: str, pattern: str, row: Callable) -> Callable[[], Callable]:
    """The vocabulary file is read on the driver; its size bounds the broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        codec = shared_codec(shared.value, pattern)
        return lambda k, t: row(codec, k, t)

    return make
