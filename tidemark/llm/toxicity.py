"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps each word to a symbol: insults (in grades of weight, by whole word or by stem), threat verbs,
targets, negations and reporting verbs; all other words are one neutral symbol. Five transducers over
these symbols add weights: an insult counts by its grade, a threat counts when it meets a target, a
target near an insult adds to it, a negation before and a reporting verb in the clause take from it. They
are composed into one deterministic machine; a text is cut into clauses, each clause that holds an insult
or a threat runs through the machine, and only matched clauses score. Their sum, greatest value and
number become a probability by a small logistic model.

The insults and the model are learned from a bounded sample (`max_rows`) of labelled rows, in which each
distinct text counts once; every word and stem of it that passes the test of evidence is an entry, save those
whose stem says as much. Threats, targets, negations and reporting verbs are short fixed lists in four languages;
the weights of their transducers are learned from the same sample.

Defined cases: null and empty texts have no clause and get the score of a text without matches; a row
without a label teaches nothing; several labels of an id or a text count as toxic if one is; ids are never inputs;
repeated rows are each scored, and teach once; a very long text is scored whole, clause by clause; words of equal
evidence are entries alike; without documents, or labels of both kinds, nothing is learned and the fixed lists
stand; other columns are ignored by rate() and kept by keep().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, id_draw, in_arrow, keep_rows, map_rows, slices

#: Word lists. Fixed values.
THREATS = "kill hurt destroy attack beat shoot stab punish burn töten schlagen verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours they them he she du dich ihr euch tu te toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called quoted quote claimed wrote reported sagte sagt schrieb dit écrit dijo escribió".split()

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = 0, 1, 2, 3, 4, 5
GRADES = 8
SYMBOLS = INSULT + GRADES
#: Set on the symbol of a word that ends its clause.
END = 0x80
_CORE = re.compile(r"^[^\w]+|[^\w]+$|_")
_CLOSES = re.compile(r"[.!?;:]\W*$")
_HOT = re.compile(bytes([91, *[THREAT], 45, *[SYMBOLS - 1], *[END | THREAT], 45, *[END | SYMBOLS - 1], 93]))
#: Stems are prefixes of these lengths.
STEMS = (4, 5, 6, 7, 8)
#: Toxic texts of the sample that an entry needs, and its least log odds less their standard error, at every size.
LEAST, EVIDENCE = 3, 2.7


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) to (state, output symbol, weight); missing arcs loop, copying. final: weight at the clause's end."""

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)
    final: dict[int, float] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """a's output read by b; states are paired as they are reached, weights add."""
    names, arcs, final, todo = {(0, 0): 0}, {}, {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        at = names[pair]
        final[at] = a.final.get(pair[0], 0.0) + b.final.get(pair[1], 0.0)
        for symbol in range(SYMBOLS):
            p, mid, w = a.step(pair[0], symbol)
            q, out, v = b.step(pair[1], mid)
            if (p, q) not in names:
                names[p, q] = len(names)
                todo.append((p, q))
            arcs[at, symbol] = (names[p, q], out, w + v)
    return Transducer(arcs, final)


#: Weights of a threat with a target, a target near an insult, a negated and a reported one, from which learning starts.
WEIGHTS = [2.0, 0.5, -1.0, -0.5]


def grammar(grades: list[float], weights: list[float] = WEIGHTS) -> Transducer:
    """The composed machine. grades: the weight of each insult symbol; weights: of the four other transducers."""
    every = range(INSULT, SYMBOLS)
    insult = Transducer({(0, s): (0, s, grades[s - INSULT]) for s in every})
    # a threat counts with a target on either side of it
    threat = Transducer(
        {(0, THREAT): (1, OTHER, 0.0), (0, TARGET): (2, TARGET, 0.0), (1, TARGET): (3, TARGET, 0.0), (2, THREAT): (3, INSULT, 0.0), (3, THREAT): (3, INSULT, 0.0)}, {3: weights[0]}
    )
    target = Transducer({(0, TARGET): (1, TARGET, 0.0), **{(0, s): (2, s, 0.0) for s in every}, **{(1, s): (3, s, 0.0) for s in every}, (2, TARGET): (3, TARGET, 0.0)}, {3: weights[1]})
    negation = Transducer({(0, NEGATION): (1, NEGATION, 0.0), **{(1, s): (2, s, 0.0) for s in every}}, {2: weights[2]})
    report = Transducer({(0, REPORT): (1, REPORT, 0.0), **{(0, s): (2, s, 0.0) for s in every}, **{(1, s): (3, s, 0.0) for s in every}, (2, REPORT): (3, REPORT, 0.0)}, {3: weights[3]})
    return compose(compose(compose(compose(insult, threat), target), negation), report)


class _Symbols(dict):
    """Symbol by raw word, remembered for a bounded number of words."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        word = _CORE.sub("", raw.lower())
        symbol = self.lexicon.get(word)
        if symbol is None:
            symbol = max((self.lexicon.get(word[:n] + "*", OTHER) for n in STEMS if len(word) > n), default=OTHER)
        if _CLOSES.search(raw):
            symbol |= END
        if len(raw) <= 64:
            self[raw] = symbol
        return symbol


@dataclass
class Model:
    """What was learned: symbols by word or stem*, grade weights, and the logistic model."""

    lexicon: dict[str, int]
    grades: list[float]
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.0, 0.0, 0.0])
    weights: list[float] = field(default_factory=lambda: list(WEIGHTS))


class Scorer:
    """Runs texts through the grammar."""

    def __init__(self, model: Model) -> None:
        self.symbols = _Symbols(model.lexicon)
        machine = grammar(model.grades, model.weights)
        states = 1 + max(s for s, _ in machine.arcs)
        self.next = [[machine.arcs[s, x][0] for x in range(SYMBOLS)] for s in range(states)]
        self.weight = [[machine.arcs[s, x][2] for x in range(SYMBOLS)] for s in range(states)]
        self.final = [machine.final.get(s, 0.0) for s in range(states)]
        self.coefficients = np.array(model.coefficients)

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that match, in order."""
        if not text:
            return []
        symbols = self.symbols
        codes = bytes([symbols[w] for w in text.replace("\n", " .\n. ").split()])
        found, done = [], 0
        for hot in _HOT.finditer(codes):
            if hot.start() < done:
                continue
            start = hot.start()
            while start > done and codes[start - 1] < END:
                start -= 1
            state, total, at = 0, 0.0, start
            while at < len(codes):
                symbol = codes[at] & 0x7F
                total += self.weight[state][symbol]
                state = self.next[state][symbol]
                at += 1
                if codes[at - 1] >= END:
                    break
            done = at
            total += self.final[state]
            if total > 0:
                found.append(total)
        return found

    def features(self, text: str | None, found: list[float]) -> list[float]:
        """Intercept, damped sum, greatest, number and density of the matched clauses."""
        total = sum(found)
        per_word = 100.0 * total / (20 + text.count(" ")) if text else 0.0
        return [1.0, float(np.log1p(total)), max(found, default=0.0), float(np.log1p(len(found))), float(np.log1p(per_word))]

    def score(self, text: str | None) -> tuple[float, int]:
        """Probability of the toxic label, and the number of matched clauses."""
        found = self.clauses(text)
        z = float(np.dot(self.coefficients, self.features(text, found)))
        return 1.0 / (1.0 + float(np.exp(-max(-30.0, min(30.0, z))))), len(found)


def _candidates(text: str) -> set[str]:
    words = {_CORE.sub("", w) for w in set(text.lower().split())}
    words = {w for w in words if any(c.isalpha() for c in w)}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word or stem, toxic and clean apart, summed over a task."""
    both = (Counter(), Counter())
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            both[toxic].update(_candidates(text or ""))
    words = list(both[0].keys() | both[1].keys())
    for k in range(0, len(words), 100_000):
        part = words[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([both[0][w] for w in part], pa.int64()), pa.array([both[1][w] for w in part], pa.int64())], names=["word", "clean", "toxic"])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) / 100 * np.eye(len(b)) + 1e-9 * np.eye(len(b)), x.T @ (y - p) - ridge * len(y) / 100 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def learn(documents: DataFrame, labels: DataFrame, train: Column, max_rows: int = 16_000) -> Model:
    """Lexicon and logistic model from about max_rows labelled rows, drawn by hash of id.

    documents and labels meet by doc_id; the drawn labels are a table of bounded size.
    """
    rated = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rated.count()
    fixed = {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}
    if n == 0:
        return Model(fixed, [1.0] * GRADES)
    draw = id_draw(F.col("doc_id"), "toxicity")
    drawn = rated.where(draw < min(1.0, max_rows / n)).select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    scratch = Scratch(documents.sparkSession, "toxicity")
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = scratch.keep(texts, "sample").repartition(64)  # max_rows rows, about
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model(fixed, [1.0] * GRADES)
    counted = in_arrow(sample, _count, T.StructType([T.StructField("word", T.StringType()), T.StructField("clean", T.LongType()), T.StructField("toxic", T.LongType())]))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    best = counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("odds", odds)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = best.where((F.col("toxic") >= LEAST) & (F.col("odds") - error > EVIDENCE)).collect()  # words of `LEAST` of the sample's texts
    picked = {r["word"]: (r["odds"], r["toxic"]) for r in top}
    # a longer stem or word whose stem says as much adds nothing
    lean = {w: v for w, v in picked.items() if not any(f"{w.rstrip('*')[:k]}*" in picked and picked[f"{w.rstrip('*')[:k]}*"][0] >= v[0] - 0.7 for k in STEMS if k < len(w.rstrip("*")))}
    values = sorted({v[0] for v in lean.values()})
    edges = np.quantile(values, np.linspace(0, 1, GRADES + 1))[1:-1] if values else np.zeros(GRADES - 1)
    grade = {w: int(np.searchsorted(edges, v[0])) for w, v in lean.items()}
    grades = [float(np.mean([lean[w][0] for w in lean if grade[w] == g] or [2.0])) / 2.0 for g in range(GRADES)]
    model = Model(fixed | {w: INSULT + g for w, g in grade.items()}, grades)
    model.weights = _learn_weights(*_collected(sample, partial(_matches, model)))
    model.coefficients = _fit(*_collected(sample, partial(_features, model)))
    return model


def _matches(model: Model) -> Callable[[str], list[float]]:
    """Intercept, the sum of all clauses by the weights given, and how many clauses each other transducer matched."""
    whole = Scorer(model)
    single = [Scorer(Model(model.lexicon, [0.0] * GRADES, weights=[float(k == i) for i in range(len(WEIGHTS))])) for k in range(len(WEIGHTS))]
    return lambda text: [1.0, sum(whole.clauses(text)), *(float(len(s.clauses(text))) for s in single)]


def _features(model: Model) -> Callable[[str], list[float]]:
    scorer = Scorer(model)
    return lambda text: scorer.features(text, scorer.clauses(text))


def _collected(sample: DataFrame, function: Callable[[], Callable[[str], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """A function of the sample's texts, with their labels; max_rows rows at most."""

    def make():
        of = function()
        return lambda text, toxic: (of(text), toxic)

    seen = map_rows(sample, make, pa.schema([("f", pa.list_(pa.float64())), ("toxic", pa.int64())])).groupBy("f", "toxic").count().collect()
    times = [r["count"] for r in seen]
    return np.repeat(np.array([r["f"] for r in seen]), times, axis=0), np.repeat(np.array([r["toxic"] for r in seen], float), times)


def _learn_weights(x: np.ndarray, y: np.ndarray) -> list[float]:
    """The four weights: where matches tell more or less than the weight they have, it moves, to a quarter or four times of it."""
    b = _fit(x, y, ridge=1e-2)
    scale = max(b[1], 0.05)
    moved = [w + d / scale for w, d in zip(WEIGHTS, b[2:], strict=True)]
    return [old * min(4.0, max(0.25, w / old)) for w, old in zip(moved, WEIGHTS, strict=True)]


def rate(df: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted and the number of matched clauses, per row."""
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("clauses", pa.int32())])

    def make():
        scorer = Scorer(model)

        def row(k, t):
            score, matched = scorer.score(t)
            return k, score, int(score >= threshold), matched

        return row

    return map_rows(df.select(key, text), make, schema)


def keep(df: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """df without the rows whose text scores threshold or more."""

    def make():
        scorer = Scorer(model)
        return lambda t: scorer.score(t)[0] < threshold

    return keep_rows(df, make, text)
