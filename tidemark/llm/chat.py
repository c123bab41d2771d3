"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth-first, in bounded packs.

A conversation is a path of turns. Conversations are range-partitioned and sorted by path, which is the
depth-first order of the tree; neighbours share their longest common prefix, and only what is new of a
path is emitted, as byte-level BPE tokens of a public vocabulary. A pack holds one stream of tokens with a
position id and a loss flag for each (positions continue the parent's, so siblings share them); per node its
span and the intervals of ancestors that it may attend to; and, per conversation, its leaf-ward list of nodes.
Packs close at `PACK` tokens and the turn that reaches them, so a first turn that a third of all conversations
share is emitted once a pack and never gathers them in one task; `repeated` tells how many of a pack's tokens
an earlier conversation of the same partition had emitted in another pack.

The template marks a turn by its role. Control strings inside a text are broken by a backslash after
their first character, and backslashes are doubled, so no control string survives and reading restores
the text. A role without marks of its own is named in its mark, with what could end the mark spelled by letters.

Defined cases: a null text is the empty text; a null role is `null`; turns are ordered by turn, then
role, then text, with nulls first; repeated rows stay repeated turns; rows with a null conv_id are turns of one
conversation; an empty table gives no packs; a very long text is one turn, and other columns are ignored.
The unit of work is one conversation, whose turns are held together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm.common import map_rows, slices

#: Marks by role; any other role is named in its mark.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
_CONTROL = re.compile(r"\\|(?=<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role:|<\|end\|>)(.)", re.S)
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<<SYS>>\n(.*?)\n<</SYS>>\n|<s>\[INST\] (.*?) \[/INST\]|<\|role:([^|]*)\|>(.*?)<\|end\|>| (.*?) </s>", re.S)
#: What a role's name must not hold, by what stands for it.
_SPELLED = {"\\": "\\\\", "|": "\\p", "<": "\\l", "[": "\\b"}
_READ = {v: k for k, v in _SPELLED.items()}
#: Tokens after which a pack is closed, at the next conversation.
PACK = 65_536


def escape(text: str) -> str:
    """Text without control strings."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[1] + "\\", text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _UNESCAPE.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string, and the span of its text in it."""
    before, after = MARKS.get(role) or (f"<|role:{''.join(_SPELLED.get(c, c) for c in role)}|>", "<|end|>")
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastindex
        if kind == 4:
            out.append((re.sub(r"\\.", lambda x: _READ[x[0]], m[3]), unescape(m[4])))
        else:
            out.append(({1: "system", 2: "user", 5: "assistant"}[kind], unescape(m[kind])))
        at = m.end()
    return out


_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("attends", pa.list_(pa.list_(pa.int64())))])
_CONV = pa.struct([("conv_id", pa.int64()), ("nodes", pa.list_(pa.int32()))])
PACKED = pa.schema([("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("nodes", pa.list_(_NODE)), ("conversations", pa.list_(_CONV)), ("repeated", pa.int64())])


class _Pack:
    """One depth-first stream. before: the path of the last conversation of the pack before."""

    def __init__(self, codec: bpe.Codec, before: list[tuple[str, str]]) -> None:
        self.codec, self.before = codec, before
        self.ids, self.positions, self.loss = ([np.empty(0, np.int32)] for _ in range(3))
        self.size = self.repeated = 0
        self.nodes: list[dict] = []
        self.conversations: list[dict] = []
        self.path: list[tuple[tuple[str, str], int, int]] = []  # turn, node, position after it

    def _tokens(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A turn's ids and loss flags; the text is encoded apart from its marks."""
        string, low, high = format_turn(role, text)
        parts = [np.frombuffer(self.codec.encode(x), "<u4").astype(np.int32) for x in (string[:low], string[low:high], string[high:])]
        return np.concatenate(parts), np.repeat([False, role == "assistant", False], [len(x) for x in parts])

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            ids, loss = self._tokens(*turn)
            start, end = self.size, self.size + len(ids)
            above: list[list[int]] = []
            position = 0
            if self.path:
                parent, position = self.nodes[self.path[-1][1]], self.path[-1][2]
                above = [*parent["attends"]]
                if above and above[-1][1] == parent["start"]:  # a chain of only children is one interval
                    above[-1] = [above[-1][0], parent["end"]]
                else:
                    above.append([parent["start"], parent["end"]])
            self.path.append((turn, len(self.nodes), position + len(ids)))
            self.nodes.append({"start": start, "end": end, "attends": above})
            self.ids.append(ids)
            self.positions.append(np.arange(position, position + len(ids), dtype=np.int32))
            self.loss.append(loss)
            if not self.conversations and turns[: len(self.path)] == self.before[: len(self.path)]:
                self.repeated += len(ids)
            self.size = end
        self.conversations.append({"conv_id": conv_id, "nodes": [k for _, k, _ in self.path]})

    def row(self) -> pa.RecordBatch:
        values = [np.concatenate(self.ids), np.concatenate(self.positions), np.concatenate(self.loss).astype(bool)]
        columns = [pa.ListArray.from_arrays(pa.array([0, self.size], pa.int32()), pa.array(v, t.value_type)) for v, t in zip(values, PACKED.types[:3], strict=True)]
        columns += [pa.array([x], t) for x, t in zip((self.nodes, self.conversations, self.repeated), PACKED.types[3:], strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=PACKED)


def _packs(batches: Iterator[pa.RecordBatch], limit: int, ranks: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = bpe.shared_codec(ranks.value, pattern)
    pack = _Pack(codec, [])
    for batch in slices(batches):
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if pack.size >= limit:
                yield pack.row()
                pack = _Pack(codec, [turn for turn, _, _ in pack.path])
            pack.add(conv_id, [(t["role"], t["text"]) for t in turns])
    if pack.conversations:
        yield pack.row()


def pack(conversations: DataFrame, vocabulary: str, pattern: str, limit: int = PACK) -> DataFrame:
    """Packs of the prefix tree of (conv_id, turn, role, text) rows, in tokens of a vocabulary file."""
    from pyspark.sql.pandas.types import from_arrow_schema

    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("null")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    hashes = F.transform("turns", lambda t: F.hex(F.xxhash64(t["role"], t["text"])))
    paths = whole.select("conv_id", "turns", F.array_join(hashes, "/").alias("path"))
    # conv_id among the range keys spreads a path that very many conversations share
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranks = conversations.sparkSession.sparkContext.broadcast(bpe.load_ranks(vocabulary))
    return ordered.select("conv_id", "turns").mapInArrow(partial(_packs, limit=limit, ranks=ranks, pattern=pattern), from_arrow_schema(PACKED))


def _read(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = bpe.shared_codec(ranks.value, pattern)
    text = lambda ids: codec.decode(ids.astype("<u4").tobytes())
    for batch in batches:
        for k in range(batch.num_rows):
            ids, positions, loss = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(3))
            nodes, conversations = (batch.column(i)[k].as_py() for i in (3, 4))
            out: list[tuple] = []
            for c in conversations:
                own = [slice(nodes[i]["start"], nodes[i]["end"]) for i in c["nodes"]]
                if not (np.concatenate([np.empty(0, int), *(positions[x] for x in own)]) == np.arange(sum(x.stop - x.start for x in own))).all():
                    raise ValueError("position ids leave a gap")
                learned = [text(ids[x][loss[x]]).decode() for x in own if loss[x].any()]
                out.append((c["conv_id"], b"".join(text(ids[x]) for x in own).decode(), learned))
            names, formatted, losses = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(formatted, pa.string()), pa.array(losses, pa.list_(pa.string()))], names=["conv_id", "formatted", "loss"])


def unpack(packs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """conv_id, formatted and the strings under the loss flags, read from the tokens of packs."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.StringType()))])
    ranks = packs.sparkSession.sparkContext.broadcast(bpe.load_ranks(vocabulary))
    return packs.mapInArrow(partial(_read, ranks=ranks, pattern=pattern), schema)


def digests(unpacked: DataFrame) -> DataFrame:
    """What the chat query returns of conversations read back."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def make():
        def row(conv_id, formatted, loss):
            turns = parse(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            learned = "".join(unescape(x) for x in loss)
            return conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)

        return row

    return map_rows(unpacked, make, schema)
