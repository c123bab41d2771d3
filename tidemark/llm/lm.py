"""Language-model scoring by a weighted backoff automaton.

Every word, pair and triple of all training texts is counted, none is left out, so what the model holds grows
with the corpus. Nothing of it but four totals passes through the driver:

1. Texts are packed, in the order they are read, into chunks of bounded size, one compressed row each.
2. A chunk lists its distinct words, pairs and triples by hash, sorted, with their training counts. The lists
   are cut by leading bits into buckets, and a bucket's part of a list is one row: cells of leading bits, the
   bytes below them and the counts, about four bytes an n-gram.
3. A bucket holds a range of hashes from all chunks. It adds up the counts and sends each chunk what the
   others add to its own.
4. A chunk meets its sums again and scores its texts.

The model is of order three with Dirichlet smoothing: P(w|context) = (c(context w) + m P(w|shorter context))
/ (c(context) + m). Every word but the end is always followed by something, so the counts of a context's
continuations add up to its own, and each state's probabilities sum to one. Order one discounts every count
by a constant; that is the probability of an unknown word. Contexts are the automaton's states, n-grams its
arcs, and each state's failure arc carries m / (c(context) + m) to its suffix. A text is scored in one pass
from left to right that carries the state and adds log probabilities. A chunk's automaton holds every arc that
its texts can take, under the numbers of its n-grams, so that an arc is found by number.

Hashes of words have 64 bits. Those of pairs and triples are cut to the bits of the corpus's size in bytes and
`SPARE` more, so at every size an n-gram meets another's hash less than once in 2 ** SPARE.

A bucket's rows are one a chunk and order, and would grow with the square of the corpus. So where there are more
than 2 ** `FAN` buckets, lists go to their buckets in several hops, each of which names `FAN` more leading bits: up to
`TEAM` holders' parts of a range are merged into one list, which goes on in their name, and what comes back for it is
handed to them. A hop moves every n-gram once either way, in lists of some hundred n-grams, at every size.

Defined cases: null and empty texts are the end token alone; without training texts every score is 0 and
nothing is known; an empty table gives no rows; repeated rows are scored and counted as often as they are
there; equal counts need no order; a text longer than a chunk is a chunk, and a block, of its own; ids only
decide what is held out (in the query, a null id has remainder 0); other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, slices

#: The end token; no word is empty.
END = b""
CHUNK_BYTES = 8 << 20
#: n-grams that a bucket holds, about, and tokens of the texts that are walked at a time.
BUCKET, BLOCK = 4_000_000, 200_000
#: Leading bits that a hop adds, and holders of lists whose parts a hop merges, about.
FAN, TEAM = 12, 4096
#: Bits of a hash of pairs or triples beyond those of the corpus's size in bytes.
SPARE = 17
#: What the shorter context counts for, by the order of the n-gram.
PRIOR = {2: 200.0, 3: 20.0}


def tokens(text: bytes) -> list[bytes]:
    """Words of lower-cased bytes, then the end."""
    words = text.split()  # bytes: ASCII white space only
    words.append(END)
    return words


# --- chunks


_CHUNK = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("train", pa.bool_())])
_CHUNKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType())])


def _packed(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK.types, strict=True)]
    with pa.ipc.new_stream(sink, _CHUNK, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=_CHUNK))
    return sink.getvalue().to_pybytes()


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, train) as chunks, named by task and place."""
    place, held, size = TaskContext.get().partitionId() << 32, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([_packed(held)], pa.binary())], names=_CHUNKS.names)

    for batch in slices(batches):
        for doc_id, text, train in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.append((doc_id, (text or "").encode().lower(), train))  # on bytes, A-Z only
            size += len(held[-1][1]) + 1
            if size >= limit:
                yield done()
                place, held, size = place + 1, [], 0
    if held:
        yield done()


class _Hashes(dict):
    """64-bit hash by word, of one chunk's words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Chunk:
    """A chunk's texts as numbers, and its distinct n-grams in order of their hashes."""

    def __init__(self, data: bytes) -> None:
        rows = pa.ipc.open_stream(data).read_all()
        self.doc_ids, self.train = rows.column("doc_id").to_pylist(), rows.column("train").to_pylist()
        hashed, texts = _Hashes().__getitem__, []
        for text in rows.column("text").to_pylist():
            said = tokens(text)
            texts.append(np.fromiter(map(hashed, said), np.uint64, len(said)))
        lengths = [len(x) for x in texts]
        self.ends = np.cumsum(lengths)
        names = np.concatenate(texts)
        train = np.repeat(np.array(self.train, np.int64), lengths)
        first = np.zeros(len(names), bool)
        first[np.append(0, self.ends[:-1])] = True
        #: Per order: names, training counts, and per token the n-gram that ends there (-1: none).
        self.names: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        #: Per pair its words, per triple its pairs: (context, suffix).
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        places = np.arange(len(names))
        for n in (1, 2, 3):
            if n > 1:
                later = ~first[places]
                if n == 3:
                    later[1:] &= places[:-1] == places[1:] - 1
                    later[:1] = False
                at = np.flatnonzero(later)
                names = _joined(names[at - 1], names[at], n) if n == 3 else _joined(names[places[at] - 1], names[places[at]], n)
                places = places[at]
            order = np.argsort(names, kind="stable")
            ranked = names[order]
            new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
            starts = np.flatnonzero(new)
            self.names[n] = ranked[starts]
            self.counts[n] = np.add.reduceat(train[places[order]], starts) if len(starts) else np.empty(0, np.int64)
            number = np.full(len(first), -1, np.int64 if len(first) >= 1 << 31 else np.int32)
            number[places[order]] = np.cumsum(new) - 1
            self.at[n] = number
            if n > 1:
                ends = places[order[starts]]
                self.parts[n] = (self.at[n - 1][ends - 1], self.at[n - 1][ends])


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams from those of their contexts and suffixes."""
    h = (a ^ (b << np.uint64(29)) ^ (b >> np.uint64(35))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# --- lists of n-grams


_LIST = struct.Struct("<IBBBII")
_INTS = [np.dtype(x) for x in ("u1", "<u2", "<u4", "<u8")]


def _ints(values: np.ndarray) -> tuple[int, bytes]:
    """The least sufficient type of unsigned integers, and the compressed values."""
    most = int(values.max(initial=0))
    kind = next(k for k, t in enumerate(_INTS) if most <= np.iinfo(t).max)
    return kind, zstandard.ZstdCompressor(level=3).compress(values.astype(_INTS[kind]).tobytes())


def _read_ints(kind: int, data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), _INTS[kind]).astype(np.int64)


def write_list(values: np.ndarray, width: int, counts: np.ndarray) -> bytes:
    """Sorted values of `width` bits, with counts: cells of leading bits, and the whole bytes below them."""
    n = len(values)
    low = max(0, -(-(width - n.bit_length() - 2) // 8))
    cells = np.bincount((values >> np.uint64(8 * low)).astype(np.int64), minlength=1) if low < 8 else np.array([n])
    (k1, a), (k2, b) = _ints(cells), _ints(counts)
    rest = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()
    return _LIST.pack(n, low, k1, k2, len(a), len(b)) + a + b + rest


def read_list(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values and counts of write_list()."""
    n, low, k1, k2, a, b = _LIST.unpack_from(data)
    at = _LIST.size
    cells, counts = _read_ints(k1, data[at : at + a]), _read_ints(k2, data[at + a : at + a + b])
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :low] = np.frombuffer(data, np.uint8, n * low, at + a + b).reshape(n, low)
    values = rest.reshape(-1).view("<u8").astype(np.uint64)
    if low < 8:
        values |= np.repeat(np.arange(len(cells), dtype=np.uint64), cells) << np.uint64(8 * low)
    return values, counts


def cut(values: np.ndarray, width: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of ranges among sorted values of `width` bits, `by` of which name the range; and the bits below those."""
    low = width - by
    starts = np.arange(1 << by, dtype=np.uint64) << np.uint64(low) if low < 64 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(values, starts), len(values)), values & np.uint64((1 << low) - 1)


@dataclass
class Layout:
    """How lists are cut: leading bits that name a range after each hop, and bits of a hash by order."""

    hops: list[int]
    bits: dict[int, int]

    @staticmethod
    def of(size: int) -> Layout:
        """For a corpus of so many bytes."""
        bucket = max(0, math.ceil(math.log2(max(1.0, size / 3 / BUCKET))))
        return Layout([*range(FAN, bucket, FAN), bucket], {1: 64, 2: (n := min(64, size.bit_length() + SPARE)), 3: n})

    def rows(self, hop: int, holder: int, n: int, values: np.ndarray, counts: np.ndarray, within: int = 0) -> pa.RecordBatch:
        """Rows (bucket, chunk, order, list) of a holder's sorted values of order n in the range `within` of the hop before."""
        known = self.hops[hop - 1] if hop else 0
        by = self.hops[hop] - known
        bounds, low = cut(values, self.bits[n] - known, by)
        full = [k for k in range(len(bounds) - 1) if bounds[k] < bounds[k + 1]]
        lists = [write_list(low[bounds[k] : bounds[k + 1]], self.bits[n] - self.hops[hop], counts[bounds[k] : bounds[k + 1]]) for k in full]
        columns = [pa.array([(within << by) + k for k in full], pa.int64()), pa.array([holder] * len(full), pa.int64()), pa.array([n] * len(full), pa.int8()), pa.array(lists, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=_LISTS.names)


_LISTS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("size", T.ByteType()), T.StructField("data", T.BinaryType())])


def _lists(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, chunk, order, list) of chunks."""
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chunk = Chunk(data.as_py())
            for n in (1, 2, 3):
                yield layout.rows(0, name, n, chunk.names[n] >> np.uint64(64 - layout.bits[n]), chunk.counts[n])


_STATS = ["tokens", "words", "once", "twice"]
_SUMS = T.StructType([*_LISTS.fields, *[T.StructField(s, T.LongType()) for s in _STATS]])


def _merged(lists: pa.Table, n: int) -> tuple[list[tuple], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of order n, their counts, the distinct values in order with their sums, and which of them each entry has."""
    rows = [r for r in zip(*[lists.column(c).to_pylist() for c in _LISTS.names], strict=True) if r[2] == n]
    read = [read_list(r[3]) for r in rows]
    values, counts = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.uint64, np.int64), zip(*read, strict=True) if read else ((), ()), strict=True))
    order = np.argsort(values, kind="stable")
    new = np.append(True, values[order[1:]] != values[order[:-1]])[: len(values)]
    of = np.empty(len(values), np.int64)
    of[order] = np.cumsum(new) - 1
    return rows, [c for _, c in read], values[order[new]], np.bincount(of, counts).astype(np.int64), of


def _added(rows: list[tuple], counts: list[np.ndarray], totals: np.ndarray, of: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, chunk, order, what others add to the list)."""
    at = 0
    for (bucket, chunk, n, _), own in zip(rows, counts, strict=True):
        kind, data = _ints(totals[of[at : at + len(own)]] - own)
        yield bucket, chunk, n, bytes([kind]) + data
        at += len(own)


def _sums(lists: pa.Table) -> pa.Table:
    """What other chunks add to each list of a bucket, and with the first row the statistics of its words."""
    out, stats = [], [0] * len(_STATS)
    for n in (1, 2, 3):
        rows, counts, _, totals, of = _merged(lists, n)
        if n == 1:
            stats = [int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())]
        out += [(*r, *([0] * len(stats) if out or k else stats)) for k, r in enumerate(_added(rows, counts, totals, of))]
    return _table(out, _SUMS)


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int8(), pa.binary(), *[pa.int64()] * len(_STATS)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema.names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=schema.names)


def _forward(layout: Layout, hop: int) -> Callable:
    """The function of (range, team) and its lists: one list for all, cut into the ranges of the next hop."""

    def forward(key, lists):
        bucket, team = (x.as_py() for x in key)
        merged = ((n, *_merged(lists, n)[2:4]) for n in (1, 2, 3))
        return pa.Table.from_batches([layout.rows(hop, team, n, values, totals, bucket) for n, values, totals in merged])

    return forward


def _back(lists: pa.Table, sums: pa.Table) -> pa.Table:
    """What others add to each list of a range that a team holds, from what others add to the team's list."""
    out = []
    for n in (1, 2, 3):
        rows, counts, _, totals, of = _merged(lists, n)
        parts = sorted((fine, data) for fine, size, data in zip(*[sums.column(c).to_pylist() for c in ("fine", "size", "data")], strict=True) if size == n)
        more = np.concatenate([np.empty(0, np.int64), *[_read_ints(data[0], data[1:]) for _, data in parts]])
        out += _added(rows, counts, totals + more, of)
    return _table(out, _LISTS)


def _exchange(lists: DataFrame, layout: Layout, hop: int, holders: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What others add to each list, by the list's range and holder; and the sums of whole buckets."""
    if hop == len(layout.hops) - 1:
        sums = scratch.keep(lists.groupBy("bucket").applyInArrow(_sums, _SUMS), "sums")
        return sums, sums
    teams = math.ceil(holders / TEAM)
    held = scratch.keep(lists, f"lists-{hop}").withColumn("team", F.pmod(F.xxhash64("chunk", F.lit(hop)), F.lit(teams)))
    merged = held.groupBy("bucket", "team").applyInArrow(_forward(layout, hop + 1), _LISTS)
    above, sums = _exchange(merged, layout, hop + 1, teams, scratch)
    by = layout.hops[hop + 1] - layout.hops[hop]
    back = above.select(F.shiftright("bucket", by).alias("bucket"), F.col("chunk").alias("team"), F.col("bucket").alias("fine"), "size", "data")
    out = scratch.keep(held.groupBy("bucket", "team").cogroup(back.groupBy("bucket", "team")).applyInArrow(_back, _LISTS), f"added-{hop}")
    scratch.drop(f"lists-{hop}")
    scratch.release()
    return out, sums


# --- scores


@dataclass
class Totals:
    """Training tokens, distinct words and the order-one discount."""

    n: int
    v: int
    discount: float

    def base(self, c: np.ndarray) -> np.ndarray:
        """Additive smoothing."""
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def own(self, c: np.ndarray) -> np.ndarray:
        """Absolute discounting; unknown words share what it takes."""
        return np.where(c > 0, c - self.discount, self.discount * self.v) / self.n


def walk(arcs: Iterator[tuple[float, float, float, bool, float, float]]) -> float:
    """Log10 probability of a text: one pass from left to right, from the root.

    Per token: the weights of its arcs from a pair, from a word and from the root, where what no training text
    holds has no arc (1.0); whether the root's arc leads to a word's state; and the weights of the failure arcs
    of the pair and of the word before it. The state is the longest context of the last words that training
    holds: a pair (2), a word (1) or the root (0).
    """
    state, total = 0, 0.0
    for three, two, one, known, fail2, fail1 in arcs:
        if state == 2:
            if three <= 0.0:
                total += three
                continue  # to the state of the pair that ends here
            total += fail2
            state = 1
        if state == 1:
            if two <= 0.0:
                total += two
                state = 2
                continue
            total += fail1
        total += one
        state = 1 if known else 0
    return total


class Automaton:
    """A chunk's n-grams as arcs, named by their numbers, between contexts as states."""

    def __init__(self, chunk: Chunk, totals: Totals, counts: dict[int, np.ndarray]) -> None:
        self.chunk, self.known = chunk, counts[1] > 0
        p, self.fail = {1: totals.own(counts[1])}, {}
        for n in (2, 3):
            context, suffix = chunk.parts[n]
            c, prior = counts[n - 1].astype(np.float64), PRIOR[n]
            self.fail[n - 1] = np.log10(prior / (c + prior))  # of contexts, to their suffixes
            p[n] = (counts[n] + prior * p[n - 1][suffix]) / (c[context] + prior)
        self.arcs = {n: np.where(counts[n] > 0, np.log10(p[n]), 1.0) for n in (2, 3)} | {1: np.log10(p[1])}

    def _block(self, start: int, stop: int) -> list[list]:
        """What walk() takes, for the tokens start..stop."""
        at = {n: x[start:stop] for n, x in self.chunk.at.items()}
        before = {n: np.append(-1, x[:-1]) for n, x in at.items()}
        arcs = [np.where(at[n] >= 0, np.append(self.arcs[n], 1.0)[at[n]], 1.0) for n in (3, 2, 1)]
        return [x.tolist() for x in (*arcs, self.known[at[1]], *(np.append(self.fail[n], 0.0)[before[n]] for n in (2, 1)))]

    def scores(self) -> Iterator[float]:
        """Of every text, in order; blocks of texts bound what is held as Python numbers."""
        start = done = 0
        ends = self.chunk.ends.tolist()
        while done < len(ends):
            upto = done + 1
            while upto < len(ends) and ends[upto] - start <= BLOCK:
                upto += 1
            arcs = zip(*self._block(start, ends[upto - 1]), strict=True)
            for k in range(done, upto):
                yield walk(islice(arcs, ends[k] - (ends[k - 1] if k else 0)))
            start, done = ends[upto - 1], upto


_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _score(texts: pa.Table, sums: pa.Table, totals: Totals) -> pa.Table:
    """One chunk and what the others add to its counts."""
    chunk = Chunk(texts.column("data")[0].as_py())
    added: dict[int, list[tuple[int, np.ndarray]]] = {1: [], 2: [], 3: []}
    for bucket, n, data in zip(*[sums.column(c).to_pylist() for c in ("bucket", "size", "data")], strict=True):
        added[n].append((bucket, _read_ints(data[0], data[1:])))
    counts = {n: chunk.counts[n] + np.concatenate([np.empty(0, np.int64), *[x for _, x in sorted(parts, key=lambda p: p[0])]]) for n, parts in added.items()}
    at, starts = chunk.at[1], np.append(0, chunk.ends[:-1])
    base = np.add.reduceat(totals.base(counts[1])[at], starts)
    scores = list(Automaton(chunk, totals, counts).scores()) if totals.n else [0.0] * len(starts)
    known = np.add.reduceat((counts[1][at] > 0).astype(np.int64), starts)
    columns = [chunk.doc_ids, [not t for t in chunk.train], chunk.ends - starts, known, base, scores]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=_SCORES.names)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row. train: the rows to learn from."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    # rows of megabytes: small row groups, so that a reader holds few of them
    small = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    chunks = scratch.keep(rows.mapInArrow(partial(_pack, limit=chunk_bytes), _CHUNKS), "chunks", **small)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).first()["b"] or 0
    layout = Layout.of(size)
    lists = chunks.mapInArrow(partial(_lists, layout=layout), _LISTS)
    added, sums = _exchange(lists, layout, 0, chunks.count() if len(layout.hops) > 1 else 1, scratch)
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS]).first()
    scratch.release()  # the lists' files, before the texts are shuffled
    seen = s["once"] + 2 * s["twice"]
    totals = Totals(s["tokens"], s["words"], min(0.95, max(0.1, s["once"] / seen)) if seen else 0.5)
    both = chunks.groupBy("chunk").cogroup(added.select("chunk", "bucket", "size", "data").groupBy("chunk"))
    return both.applyInArrow(partial(_score, totals=totals), _SCORES).withColumn("train_tokens", F.lit(totals.n).cast("long"))
