"""MinHash near-duplicates by an inverted join on signature coordinates.

1. A text's set of word shingles is hashed; equal sets form one class, and each class has a signature of
   `coordinates` minimum hashes.
2. Classes are posted under each (coordinate, value) pair. Pairs are ordered by how many classes they hold,
   rarest first, and a class keeps only the prefix of its pairs that two classes with `matches` equal
   coordinates cannot both miss. Pairs that one class holds come first in the order, so a class with
   enough of them is done, and long posting lists are skipped.
3. Each posting list is merged with its least class only, which costs a list's length, not its square.
   Collisions are counted per pair of classes; the coordinates whose lists were skipped are then probed in
   both signatures, and pairs whose count reaches `matches` are confirmed on full sets.
4. Classes of lists that still hold several components are cut into as many bands of coordinates as a
   pair may have unequal ones, and one more: a pair with `matches` equal ones has a whole band in common.
   Classes that share a band are a family, so families stay small as the corpus grows and chance joins
   lists. In a family, classes outside its largest component are compared with all others in tiles: first
   by matching coordinates alone, where a pair counts in its first common band only; what has a partner
   there then by full sets, in tiles bounded in classes and in shingles. No link is lost, and a component
   of many copies is never compared with itself. Tiles are dealt in rounds, each of which moves no more than a
   multiple of the corpus: the work of families may grow with their square, the disk it takes does not.
   Classes are gathered to blocks once; rounds deal blocks, so a family's rows do not grow with its rounds.
   Full sets are made only of classes whose signatures met a partner's, in lists or in families.
5. Links are contracted to components by repeated minima.

`matches` lies more than five standard deviations below what a pair at the threshold has, so that a pair is
missed about once in a million. Classes and shingles are named by 64-bit hashes.

Defined cases: words are what white space leaves, with A-Z lower-cased; a text of fewer words than a
shingle is one shingle; null texts and texts without words have size 0 and are linked with nothing;
repeated rows are one class and all returned; rows without an id are returned unlinked, with a null
component and kept false; rows that share an id but not a text are documents of their own, told apart by
`text_hash`; a very long text is one set, held whole; of equal ids the least is the component's, and of lists of
equal length the one of least hash comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, in_arrow, slices

COORDINATES = 64
#: Classes a tile holds of either side, about; as many shingles as SHINGLES count as one more.
TILE, SHINGLES = 128, 1024
#: The same where a tile holds signatures only.
SIGNATURES = 1024
#: Signatures, and sets by weight, that a round of tiles moves for each class of the corpus, about; and at least.
ROUND, SETS_ROUND, LEAST_ROUND = 2, 1 / 8, 1 << 15
#: Rounds' worth of blocks that are kept at once, about, and how: a reader may hold a row group, so it has few of them.
HELD, GROUPS = 2, {"parquet.block.row.count.limit": 64}
_MIX = np.random.default_rng(20240607).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Words(dict):
    """64-bit hash by word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str | None, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * _ODD[i % 5]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each coordinate's 32-bit hashes, as signed integers."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        mixed = (part[None, :] ^ _MIX[0][:, None]) * _MIX[1][:, None]
        least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32).view(np.int32)


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in slices(batches):
        n, nodes, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, size, words)
            n.append(len(s))
            nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
            sigs.append(signature(s))
        flat = pa.array(np.concatenate(sigs), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * COORDINATES), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), lists], names=_SIGNED.names)


_SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])


def _full(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in slices(batches):
        sets = [shingles(t, size, words) for t in batch.column(1).to_pylist()]
        right = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 == k for s, k in zip(sets, batch.column(0).to_pylist(), strict=True)]
        batch = batch.filter(pa.array(right))  # a repeated id may also bring the text of another class
        sets = [s.view(np.int64) for s, ok in zip(sets, right, strict=True) if ok]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "s"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """(node, comp) for the ends of (a, b) edges; comp is one of the component's nodes. None without edges."""
    steps: list[DataFrame] = []
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), f"{name}-up{len(steps)}")
        steps.append(parent)
        up = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        moved = edges.join(up("a"), "a").join(up("b"), "b").select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b")).where("a <> b").distinct()
        edges = scratch.keep(moved, f"{name}-{len(steps)}")
    if not steps:
        return None
    out = steps[0].select("node", F.col("up").alias("comp"))
    for parent in steps[1:]:
        out = out.join(parent.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return scratch.keep(out, f"{name}-of")


def _linked(common: Column, n: Column, m: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in integers."""
    return common * 100 >= (n + m - common) * percent


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_MET = T.StructType([T.StructField("fam", T.LongType()), T.StructField("node", T.LongType())])


class _Block:
    """Classes of a family as arrays; sets: None where only signatures are dealt."""

    def __init__(self, classes: pa.StructArray) -> None:
        node, comp, n, sig, *sets = classes.flatten()
        self.node, self.comp, self.n = node.to_numpy(), comp.to_numpy(), n.to_numpy()
        self.sig = sig.flatten().to_numpy().reshape(-1, COORDINATES)
        self.sets = np.split(sets[0].flatten().to_numpy(), np.cumsum(sets[0].value_lengths().to_numpy())[:-1]) if sets else None


def _meet(asks: _Block, others: _Block, band: int, matches: int, percent: int) -> set[int]:
    """Classes of two blocks that have a partner in another component whose first common band is this."""
    starts = [start for start, _ in bands(matches)]
    met: set[int] = set()
    for q in range(len(asks.node)):
        n = int(asks.n[q])
        equal = others.sig == asks.sig[q]
        near = (others.comp != asks.comp[q]) & (np.minimum(others.n, n) * 100 >= np.maximum(others.n, n) * percent) & (equal.sum(axis=1) >= matches)
        candidates = np.flatnonzero(near)
        if len(candidates):
            candidates = candidates[np.logical_and.reduceat(equal[candidates], starts, axis=1).argmax(axis=1) == band]
        if len(candidates):
            met.add(int(asks.node[q]))
            met.update(others.node[candidates].tolist())
    return met


def _tile(asks: _Block, others: _Block, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links between the classes of two blocks, as many as join their components."""
    up = {int(c): int(c) for x in (asks, others) for c in x.comp}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    found = []
    for q in range(len(asks.node)):
        equal = (others.sig == asks.sig[q]).sum(axis=1)
        n = int(asks.n[q])
        near = (np.minimum(others.n, n) * 100 >= np.maximum(others.n, n) * percent) & (others.node != asks.node[q]) & (equal >= matches)
        candidates = np.flatnonzero(near)
        for k in candidates[np.argsort(-equal[near], kind="stable")]:
            a, b = top(int(asks.comp[q])), top(int(others.comp[k]))
            if a == b:
                continue
            common = len(np.intersect1d(asks.sets[q], others.sets[k], assume_unique=True))
            if common * 100 >= (n + int(others.n[k]) - common) * percent:
                up[a] = b
                found.append((int(asks.node[q]), int(others.node[k])))
    return found


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], _Block, _Block]]:
    """Each tile's fam, band, i and j, the block that asks and the one that is asked, which comes first."""
    others = key = None
    for batch in batches:
        for k in range(batch.num_rows):
            *at, ask = (batch.column(c)[k].as_py() for c in ("fam", "band", "i", "j", "ask"))
            block = _Block(batch.column("block")[k].values)
            if not ask:
                others, key = block, at
            elif at == key:
                yield at, block, others


def _meetings(batches: Iterator[pa.RecordBatch], matches: int, percent: int) -> Iterator[pa.RecordBatch]:
    for (fam, band, *_), asks, others in _pairs(batches):
        met = list(_meet(asks, others, band, matches, percent))
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([fam] * len(met), pa.int64()), pa.array(met, pa.int64())], names=_MET.names)


def _tiles(batches: Iterator[pa.RecordBatch], matches: int, percent: int) -> Iterator[pa.RecordBatch]:
    for _, asks, others in _pairs(batches):
        links = _tile(asks, others, matches, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def bands(matches: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of the coordinates, of which classes with `matches` equal ones have a whole one in common."""
    edges = np.linspace(0, COORDINATES, COORDINATES - matches + 2).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def least_matches(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has but about once in a million."""
    t = percent / 100
    return max(1, math.floor(COORDINATES * t - 5.2 * math.sqrt(COORDINATES * t * (1 - t))))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash per row; see the module for the method."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.keep(in_arrow(rows.withColumn("text_hash", F.xxhash64("text")), partial(_sign, size=size), _SIGNED), "signed")
    matches = least_matches(percent)
    prefix = COORDINATES - matches + 1

    nodes = scratch.keep(signed.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    posts = nodes.select("node", F.posexplode("sig").alias("k", "v")).select("node", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long")).alias("pair"))
    shared = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    listed = posts.join(shared, "pair").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("cnt", "pair"))).alias("ps"))
    take = F.size("ps") - (COORDINATES - prefix)  # pairs of its own come first in the prefix
    posted = scratch.keep(listed.where(take > 0).select("node", F.explode(F.slice("ps", F.lit(1), take)).alias("p")).select("node", "p.pair"), "posted")
    scratch.release(last=True)

    heads = posted.groupBy("pair").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    merged = F.bit_or(F.expr("shiftleft(1L, cast(shiftright(pair + 2147483648L, 32) as int))"))  # a pair is its coordinate * 2 ** 32 + a signed value
    met = posted.join(heads, "pair").where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("collisions"), merged.alias("merged"))
    sized = nodes.select("node", "n", "sig")
    head = sized.select(F.col("node").alias("head"), F.col("n").alias("m"), F.col("sig").alias("hsig"))
    skipped = F.expr(f"size(filter(sequence(0, {COORDINATES - 1}), k -> sig[k] = hsig[k] and getbit(merged, k) = 0))")
    near = met.join(sized, "node").join(head, "head").where((F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("collisions") + skipped >= matches)).select("node", "head", "n", "m")
    near = scratch.keep(near, "near")
    scratch.release(last=True)

    def full(wanted: DataFrame, name: str) -> DataFrame:
        """Full sets of some classes, read again from one text of each."""
        chosen = nodes.select("node", F.col("id").alias("doc_id")).join(wanted, "node", "left_semi")
        out = scratch.keep(in_arrow(rows.join(chosen, "doc_id").select("node", "text"), partial(_full, size=size), _SETS).dropDuplicates(["node"]), name)
        scratch.release(last=True)
        return out

    sets = full(near.select("node").unionByName(near.select(F.col("head").alias("node"))), "sets")
    common = F.size(F.array_intersect("s", "hs"))
    links = near.join(sets, "node").join(sets.select(F.col("node").alias("head"), F.col("s").alias("hs")), "head").where(_linked(common, F.col("n"), F.col("m"), percent))
    links = scratch.keep(links.select(F.col("node").alias("a"), F.col("head").alias("b")), "links")
    scratch.drop("near", "sets")
    scratch.release(last=True)
    first = components(links, scratch, "first")
    later = _between(posted, first, sized, partial(full, name="sets-met"), scratch, matches, percent)
    scratch.drop("posted", "families", "members", "sets-met")
    final = first
    if later is not None:
        whole = components(links.unionByName(later), scratch, "all")
        final = whole if whole is not None else first
    labels = nodes.select("node", "id")
    labels = labels.withColumn("comp", F.col("node")) if final is None else labels.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = labels.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = labels.join(least, "comp").select("node", "component_id")
    out = signed.select("doc_id", "n", "node", "text_hash").join(named, "node", "left")
    scratch.release(last=True)
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_hash")


def _between(posted: DataFrame, comps: DataFrame | None, sized: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], scratch: Scratch, matches: int, percent: int) -> DataFrame | None:
    """Links between different components that share a posting list; None if no list holds two. sets: full sets, or what reads those of some classes."""
    placed = posted.withColumn("comp", F.col("node")) if comps is None else posted.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("pair").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("pair")
    open_ = scratch.keep(placed.join(mixed, "pair").select("node", "comp").distinct(), "open")
    if open_.isEmpty():
        return None
    scratch.release(last=True)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.slice("sig", start + 1, end - start)).alias("fam")) for i, (start, end) in enumerate(bands(matches))]))
    cells = open_.join(sized, "node").select("node", "comp", keys.alias("key")).select("node", "comp", "key.band", "key.fam")
    several = cells.groupBy("fam").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("fam")
    families = scratch.keep(cells.join(several, "fam").withColumn("w", F.lit(1)), "families")
    scratch.release(last=True)
    classes = sized.count()
    met = _compare(families, sized, SIGNATURES, partial(_meetings, matches=matches, percent=percent), _MET, scratch, "met", ROUND * classes)
    weighed = sized.select("node", (1 + F.expr(f"n div {SHINGLES}")).alias("w"))
    members = scratch.keep(met.distinct().withColumn("band", F.lit(0)).join(open_, "node").join(weighed, "node"), "members")
    scratch.release(last=True)
    sets = sets(members.select("node")) if callable(sets) else sets
    return _compare(members, sized.join(sets, "node"), TILE, partial(_tiles, matches=matches, percent=percent), _LINK, scratch, "later", SETS_ROUND * classes)


def _compare(members: DataFrame, classes: DataFrame, tile: int, compare: Callable, schema: T.StructType, scratch: Scratch, name: str, most: float) -> DataFrame:
    """What compare finds in the tiles of the families in members (fam, band, node, comp, w).

    Families are taken in turns, each of which makes the blocks of its own once, about HELD * `most` by weight; blocks are
    dealt to tiles in rounds that move about `most`. So a class is joined once for each family that it is in, however
    many tiles its blocks are in.
    """
    most = max(most, LEAST_ROUND)
    sizes = scratch.keep(_sizes(members, tile), f"{name}-sizes")
    weight = lambda df, w: df.agg(F.sum(w)).first()[0] or 0
    turns = max(1, math.ceil(weight(sizes, F.col("m") + F.col("outside")) / (HELD * most)))
    found = []
    for turn in range(turns):
        mine = F.pmod(F.xxhash64("fam"), F.lit(turns)) == turn
        own = sizes.where(mine)
        rounds = math.ceil(weight(own, F.col("m") * F.col("asks") + F.col("outside") * F.col("all")) / most)
        blocks = _blocks(members.where(mine), own, classes)
        if rounds > 1:
            blocks = scratch.keep(blocks, f"{name}-blocks/{turn}", **GROUPS)
            scratch.release(last=True)
        for k in range(rounds):
            found.append(f"{name}/{turn}-{k}")
            scratch.keep(in_arrow(_deal(blocks, rounds, k), compare, schema), found[-1])
            scratch.release(last=True)
        scratch.drop(f"{name}-blocks/{turn}")
    if not found:
        return scratch.spark.createDataFrame([], schema)
    return scratch.spark.read.schema(schema).parquet(*[f"{scratch.root}/{x}" for x in found])


def _sizes(members: DataFrame, tile: int) -> DataFrame:
    """Per family: main, its largest component; m and outside, the weight of all and of those outside it; all and asks, their blocks."""
    counted = members.groupBy("fam", "comp").agg(F.sum("w").alias("c")).groupBy("fam").agg(F.max(F.struct("c", "comp")).alias("largest"), F.sum("c").alias("m"))
    size = counted.select("fam", F.col("largest.comp").alias("main"), "m", (F.col("m") - F.col("largest.c")).alias("outside"))
    return size.withColumns({"asks": F.ceil(F.col("outside") / tile).cast("int"), "all": F.ceil(F.col("m") / tile).cast("int")}).where("asks > 0")


def _blocks(members: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Families' blocks of classes, as rows: the classes outside the main component ask, all of the family are asked."""
    dealt = members.join(sizes.select("fam", "main", "asks", "all"), "fam")
    spread = F.xxhash64("node")
    asked = F.struct(F.lit(False).alias("ask"), F.pmod(spread, F.col("all")).cast("int").alias("place"))
    asking = F.struct(F.lit(True).alias("ask"), F.pmod(spread, F.col("asks")).cast("int").alias("place"))
    sides = F.explode(F.when(F.col("comp") == F.col("main"), F.array(asked)).otherwise(F.array(asked, asking)))
    content = F.struct("node", "comp", *[c for c in classes.columns if c != "node"])
    placed = dealt.select("fam", "band", "node", "comp", "asks", "all", sides.alias("side"))
    placed = placed.join(classes, "node").select("fam", "band", "asks", "all", content.alias("c"), "side")
    return placed.groupBy("fam", "band", "asks", "all", "side.ask", "side.place").agg(F.collect_list("c").alias("block"))


def _deal(blocks: DataFrame, rounds: int = 1, turn: int = 0) -> DataFrame:
    """A round's tiles: two rows each, the block that is asked and the one that asks. A block that asks does so in one round."""
    due = lambda place: F.pmod(F.xxhash64("fam", place), F.lit(rounds)) == turn
    asks = F.filter(F.sequence(F.lit(0), F.col("asks") - 1), due)
    held = F.when(F.col("ask"), due(F.col("place"))).otherwise(F.size(asks) > 0)
    across = F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), F.col("all") - 1)).otherwise(asks))
    at = [F.when(F.col("ask"), F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (("i", "place", "other"), ("j", "other", "place"))]
    rows = blocks.where(held).withColumn("other", across).select("fam", "band", *at, "ask", "block")
    return rows.repartition("fam", "i", "j").sortWithinPartitions("fam", "band", "i", "j", "ask")
