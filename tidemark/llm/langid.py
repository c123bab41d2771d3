"""Language by compression: the language whose zstandard raw-content dictionary encodes a text smallest.

Training takes a bounded sample of labelled rows: `per_language` rows by hash of id, and of each a piece of
`piece` characters at a hashed position. A language's pieces are its raw-content dictionary; nothing of them is
cut. A text is encoded whole, in blocks short enough that the dictionary and not the text itself decides, once
per language; sizes are summed. Sizes are whole bytes, and a text of a few words is stored as it is. So where
the two least are within `NARROW`, the blocks are encoded again, at a higher level and after each of several
stretches of the dictionary, and what they add to the stretches' own sizes is summed: the same measure, finer.

Defined cases: null texts and texts without a letter are `und` with score 0; remaining ties go to the
language first in order; a text whose margin is under `min_margin` of its size is marked rejected but still
named, as is one in a script that no language has; no training rows make every text `und`; rows with a null
language or text teach nothing; repeated rows are each named; a very long text is encoded whole, block by block;
an empty table gives no rows; other columns are ignored by identify() and kept by keep().
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_draw, keep_rows, map_rows

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of a block that is encoded at a time.
BLOCK = 2048
#: Levels of the first and the finer look, and the margin between the two.
LEVEL, FINE, NARROW = 6, 12, 0.05
#: Stretches of a dictionary that a block is encoded after, and their characters.
STRETCHES, STRETCH = 8, 400
#: Margin under which a language is not told.
MARGIN = 0.001
_GAPS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words, one space apart: digits and punctuation say nothing of a language."""
    return _GAPS.sub(" ", text.lower())


def learn(df: DataFrame, train: Column, lang: str = "lang", per_language: int = 600, piece: int = 320) -> dict[str, bytes]:
    """Dictionary content per language, from a sample bounded by per_language * piece characters each."""
    rows = df.where(train & F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row per language
    if not counts:
        return {}
    draw = id_draw(F.col("doc_id"), "langid")
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    start = 1 + F.floor(id_draw(F.col("doc_id"), "piece") * (F.greatest(F.length("text") - piece, F.lit(0)) + 1))
    taken = rows.where(draw < F.element_at(share, F.col(lang))).select(lang, F.substring("text", start.cast("int"), F.lit(piece)).alias("t"), draw.alias("d"), "doc_id")
    parts: dict[str, list] = defaultdict(list)
    for r in taken.collect():
        if r["t"]:
            parts[r[lang]].append((r["d"], r["doc_id"] or 0, r["t"]))
    return {name: "\n".join(letters(t) for _, _, t in sorted(p)).encode() for name, p in sorted(parts.items())}


def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False)


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, content: dict[str, bytes]) -> None:
        self.names = sorted(content)
        self.coders = [_coder(content[name], LEVEL) for name in self.names]
        self.fine = [_coder(content[name], FINE) for name in self.names]
        self.stretches = []
        for name, coder in zip(self.names, self.fine, strict=True):
            text = content[name].decode(errors="ignore")
            step = max(1, len(text) // (STRETCHES + 1))
            cut = [(text[k * step : k * step + STRETCH] + " ").encode() for k in range(1, STRETCHES + 1)]
            self.stretches.append((cut, sum(len(coder.compress(x)) for x in cut)))

    def sizes(self, blocks: list[bytes]) -> list[int]:
        """Bytes per language."""
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def finer(self, blocks: list[bytes]) -> list[int]:
        """Bytes per language that the blocks add to those of the stretches."""
        return [sum(len(c.compress(x + b)) for b in blocks for x in cut) - own * len(blocks) for c, (cut, own) in zip(self.fine, self.stretches, strict=True)]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (the runner-up's surplus over the best size)."""
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0, 1.0
        data = letters(text).strip().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        for measure in (self.sizes, self.finer):
            sizes = measure(blocks)
            order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
            best, second = sizes[order[0]], sizes[order[1]]
            margin = (second - best) / max(best, 1)
            if margin >= NARROW:
                break
        return self.names[order[0]], min(1.0, 0.5 + 4 * margin), margin


def identify(df: DataFrame, content: dict[str, bytes], min_margin: float = MARGIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, margin and rejected per row."""
    schema = pa.schema([(key, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    def make():
        model = Classifier(content)

        def row(k, t):
            name, score, margin = model.classify(t)
            return k, name, score, margin, name == "und" or margin < min_margin

        return row

    return map_rows(df.select(key, text), make, schema)


def keep(df: DataFrame, content: dict[str, bytes], min_margin: float = MARGIN, text: str = "text") -> DataFrame:
    """df without the rows that have no language, or one by too narrow a margin."""

    def make():
        model = Classifier(content)

        def told(t):
            name, _, margin = model.classify(t)
            return name != "und" and margin >= min_margin

        return told

    return keep_rows(df, make, text)
