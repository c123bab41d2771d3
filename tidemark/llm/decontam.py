"""Benchmark decontamination by the q-gram lemma in overlapping diagonal bands.

Text and items are normalised to lower-case words, one space apart. An item of m characters that occurs in
a text with at most e edits shares at least m - q + 1 - q*e of its q-grams with it, on diagonals (text
position minus item position) no more than e apart. So shared q-grams are counted per item in diagonal
bands of width 2(e+1) that overlap by half; bands that reach the bound are verified by an alignment
confined to the band. q falls with an item's length, so that e can be 8 % of m and 15 % of the q-grams must
still remain. Items of fewer than 12 characters, which allow no edit, are looked up as whole words. Items are the stated query set: they are taken in blocks of bounded size, and each
block is held against all texts.

Defined cases: null and empty texts are clean; null items and items without a letter or digit are ignored;
repeated items all report; repeated rows are each judged; an empty benchmark makes every text clean; an empty
table gives no rows; a very long text is searched whole, one at a time; of bands that tie the first is aligned
first, and an item reports once; other columns are ignored by find() and kept by keep().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, keep_rows, map_rows

#: Characters of the longest q-grams; shorter items are looked up whole.
Q = 12
#: Share of an item's q-grams that must remain.
REMAIN = 0.15
#: Edits allowed per character of an item.
RATE = 0.08
#: Characters of items a block may hold.
BLOCK_CHARS = 2_000_000
_GAP = re.compile(r"[\W_]+")
_BITS = 22


def normalise(text: str) -> str:
    """Lower-case words, one space apart."""
    return _GAP.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram, from those of shorter ones."""
    n = len(points) - q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    a = np.uint64(0x9E3779B97F4A7C15)
    part, width = points.astype(np.uint64) + np.uint64(1), 1
    h, done = np.zeros(n, np.uint64), 0
    while True:
        salt = a ^ (a >> np.uint64(width))
        if q & width:
            h = h * salt + part[done : done + n]
            done += width
        if done == q:
            break
        part, width = part[:-width] * salt + part[width:], 2 * width
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def budget(m: int) -> int:
    """Edits allowed in an item of m characters."""
    return int(m * RATE)


def gram_size(m: int) -> int:
    """The longest q, up to 12, of which `REMAIN` of an item's q-grams are left by its edits."""
    return next(q for q in range(min(Q, m), 0, -1) if m - q + 1 - q * budget(m) >= max(1, REMAIN * (m - q + 1)))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits of the whole item against the text on diagonals low..high, and the text position it ends at.

    None if that takes more than `most` edits, which unrelated stretches show after a few rows.
    """
    width, m = high - low + 1, len(item)
    off = most + 1
    # the text's characters that the band can touch, fenced by a character that no item holds
    window = np.full(width + m, 0xFFFFFFFF, np.uint32)
    begin, end = max(0, low), min(len(text), high + m)
    if end <= begin:
        return None
    window[begin - low : end - low] = text[begin:end]
    row = np.zeros(width + 1, np.int32)
    row[width] = off
    order = np.arange(width, dtype=np.int32)
    for i in range(m):
        best = np.minimum(row[:-1] + (window[i : i + width] != item[i]), row[1:] + 1)
        row[:-1] = np.minimum.accumulate(best - order) + order
        if row[:-1].min() > most:
            return None
    k = int(row[:-1].argmin())
    return int(row[k]), min(len(text), low + k + m)


class Whole:
    """Short items, by their words."""

    def __init__(self, items: list[tuple[int, int, str]]) -> None:
        self.items: dict[str, list[tuple[int, int]]] = {}
        for place, i, t in items:
            self.items.setdefault(t, []).append((place, i))
        self.lengths = sorted({t.count(" ") + 1 for t in self.items})

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(place, item id, end, edits) of every item that occurs, once each."""
        words = text.split(" ")
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        found: dict[str, int] = {}
        for n in self.lengths:
            for k in range(len(words) - n + 1):
                if (t := " ".join(words[k : k + n])) in self.items:
                    found.setdefault(t, int(ends[k + n - 1]))
        return [(place, i, end, 0) for t, end in found.items() for place, i in self.items[t]]


class Index:
    """A block of items: short ones whole, the others by the size of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept: dict[int, list[tuple[int, int, str]]] = {}
        for place, (i, t) in enumerate((i, normalise(t)) for i, t in items):
            if t:
                kept.setdefault(0 if len(t) < Q else gram_size(len(t)), []).append((place, i, t))
        self.whole = Whole(kept.pop(0, []))
        self.parts = [Grams(q, part) for q, part in sorted(kept.items())]

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, position it ends at in the normalised text, edits) of every item that occurs, once each."""
        plain = normalise(text)
        found = self.whole.search(plain) if self.whole.items else []
        points = codes(plain)
        for part in self.parts:
            found += part.search(points)
        return [x[1:] for x in sorted(found)]


class Grams:
    """Items by q-grams of one size."""

    def __init__(self, q: int, items: list[tuple[int, int, str]]) -> None:
        self.q = q
        self.names = [(place, i) for place, i, _ in items]
        self.points = [codes(t) for _, _, t in items]
        self.sizes = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([budget(len(p)) for p in self.points], np.int64)
        self.need = np.maximum(1, self.sizes - q + 1 - q * self.edits)
        hashes = [grams(p, q) for p in self.points]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.start, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(place, item id, end, edits) of every item that occurs, once each, fullest band first."""
        h = grams(points, self.q)
        if not len(h) or not len(self.keys):
            return []
        pos = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[pos])
        at[at == len(self.keys)] = 0
        real = self.keys[at] == h[pos]
        pos, at = pos[real], at[real]
        if not len(pos):
            return []
        many = self.count[at]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        slot = np.repeat(self.start[at], many) + within
        item = self.owner[slot]
        diagonal = np.repeat(pos, many) - self.place[slot]
        stride = self.edits[item] + 1
        band = np.floor_divide(diagonal, stride)
        shift = len(points) + int(self.sizes.max()) + 2
        key = item * (2 * shift) + band + shift
        doubled, place = np.concatenate([key, key - 1]), np.tile(self.place[slot], 2)  # each diagonal is in two bands
        order = np.argsort(doubled, kind="stable")
        doubled, place = doubled[order], place[order]
        first = np.flatnonzero(np.append(True, doubled[1:] != doubled[:-1]))
        counts = np.diff(np.append(first, len(doubled)))
        hot = np.flatnonzero(counts >= self.need[doubled[first] // (2 * shift)])
        found: dict[int, tuple[int, int]] = {}
        for x in hot[np.argsort(-counts[hot], kind="stable")].tolist():
            b = int(doubled[first[x]])
            k, which = b // (2 * shift), b % (2 * shift) - shift
            if k in found or len(np.unique(place[first[x] : first[x] + counts[x]])) < self.need[k]:
                continue
            e = int(self.edits[k])
            if (seen := align(self.points[k], points, which * (e + 1) - e, (which + 2) * (e + 1) + e, e)) is not None:
                found[k] = seen
        return [(*self.names[k], end, edits) for k, (edits, end) in found.items()]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items, each read on its own and bounded in size."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item), F.lit(-1)).cast("long").alias("i"), F.col(text).alias("t"))
    chars = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):  # one block at a time passes the driver
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def _in_turn(df: DataFrame, blocks: Iterator[list[tuple[int, str]]], step: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """step for every block. The rows are written between blocks, so that no worker holds two indexes."""
    scratch, shared = Scratch(df.sparkSession, "decontamination"), None
    for k, block in enumerate(blocks):
        if shared is not None:
            df = scratch.keep(df, f"after-{k}")
            scratch.drop(f"after-{k - 1}")
            shared.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(block)
        df = step(df, shared)
    return df


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, contaminated, item_ids, least_edits and the text's spans per row: one map over the rows for each block of items."""
    schema = pa.schema([(key, pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.list_(pa.int64())))])
    out = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).withColumn("hits", F.array().cast("array<array<bigint>>"))

    def make(shared):
        index = Index(shared.value)
        return lambda k, t, hits: (k, t, [*hits, *map(list, index.search(t))] if t else hits)

    out = _in_turn(out, _blocks(benchmark, item, item_text), lambda df, shared: map_rows(df, partial(make, shared), schema))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h[0])))
    return out.select(key, (F.size("hits") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("hits", lambda h: h[2])).alias("least_edits"), F.transform("hits", lambda h: h[1]).alias("ends"))


def keep(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the rows whose text holds an item; blocks of items filter one after another."""

    def make(shared):
        index = Index(shared.value)
        return lambda t: not (t and index.search(t))

    return _in_turn(df, _blocks(benchmark, item, item_text), lambda rows, shared: keep_rows(rows, partial(make, shared), text))
