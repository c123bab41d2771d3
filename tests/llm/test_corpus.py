"""Operators that hold texts against each other or against the corpus, against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS
from tidemark.llm import common, decontam, lm, minhash, queries

SF = "/root/testdata/sf0.001"


def texts(sf=SF):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


# --- near-duplicates


def brute_groups(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations([k for k, (i, _) in enumerate(rows) if i is not None and sets[k]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((str(i), len(sets[k]), str(None if i is None else least[top(k)]), i is not None and least[top(k)] == i) for k, (i, _) in enumerate(rows))


def found_groups(df, size, percent):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(df, size, percent).collect())


def test_groups_of_the_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = texts()
    assert found_groups(df, 3, 85) == brute_groups(rows, 3, 85)


def test_odd_rows_and_dense_families(spark, wide, nothing):
    assert found_groups(wide, 3, 85) == brute_groups(DOCS, 3, 85)
    random.seed(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):  # edits that leave many pairs just above and just below the threshold, and chains
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 5, 9])):
            w[random.randrange(60)] = f"x{random.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found_groups(df, 3, 85) == brute_groups(rows, 3, 85)
    assert minhash.near_duplicates(nothing, 5, 80).count() == 0


def test_small_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "SHINGLES", 10)
    random.seed(8)
    rows = [(i, " ".join([f"w{k}" if random.random() > 0.05 else f"y{random.randrange(99)}" for k in range(50)])) for i in range(60)]
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85) == brute_groups(rows, 3, 85)


def test_intermediate_tables_are_deleted(spark, docs):
    from pathlib import Path

    from tidemark.llm import common

    assert minhash.near_duplicates(docs).count() == len(DOCS)
    folders = [Path(s.root.removeprefix("file://")) for s in common._OPEN]
    assert any(f.exists() for f in folders)
    common.close_all()
    assert not any(f.exists() for f in folders)


# --- language model


def test_base_and_counts(spark, wide, nothing):
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), texts()), (wide, DOCS)):
        held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
        said = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]) for i, t in rows]
        c = Counter(w for i, ws in said if not held[i] for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), held[i], len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in said)
        rest = queries.common.id_remainder(F.col("doc_id"), 10) != 0
        got = lm.score(df.select("doc_id", "text"), rest).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert lm.score(nothing, F.lit(True)).count() == 0
    assert [r["score"] for r in lm.score(wide.limit(2), F.lit(False)).collect()] == [0.0, 0.0]


def plain_model(learned):
    """Probability of a word after a context, by its definition; every word, pair and triple counts."""
    grams = Counter(tuple(ws[k : k + size]) for ws in learned for size in (1, 2, 3) for k in range(len(ws) - size + 1))
    one = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, once, twice = sum(one.values()), *(sum(c == k for c in one.values()) for k in (1, 2))
    d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    def p(w, context):
        if not context:
            return (one[w] - d if w in one else d * len(one)) / n
        c, prior = grams[context], lm.PRIOR[len(context) + 1]
        return (grams[(*context, w)] + prior * p(w, context[1:])) / (c + prior)

    return p, one


def test_states_sum_to_one():
    random.seed(3)
    learned = [[random.choice([b"a", b"a", b"b", b"c"]) for _ in range(random.randrange(30))] + [lm.END] for _ in range(50)]
    p, one = plain_model(learned)
    for context in [(), (b"a",), (b"c", b"a"), (b"a", b"a"), (b"b", b"b"), (b"x",)]:
        assert math.isclose(sum(p(w, context) for w in [*one, b"unknown"]), 1)


@pytest.mark.parametrize(("limit", "fan"), [(lm.CHUNK_BYTES, lm.FAN), (20_000, lm.FAN), (20_000, 2)])
def test_scores_match_the_definition(spark, monkeypatch, limit, fan):
    """The whole query path, whichever chunks, hops, buckets and blocks hold an n-gram, without an automaton."""
    rows = texts() + [(10**6 + k, t) for k, (_, t) in enumerate(DOCS)]
    monkeypatch.setattr(lm, "FAN", fan)
    if limit < lm.CHUNK_BYTES:
        monkeypatch.setattr(lm, "BUCKET", 5_000)
        monkeypatch.setattr(lm, "BLOCK", 500)
        monkeypatch.setattr(lm, "TEAM", 3)
        assert (len(lm.Layout.of(sum(len((t or "").encode()) + 1 for _, t in rows)).hops) > 2) == (fan == 2)
    said = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    p, _ = plain_model([ws for i, ws in said.items() if zlib.crc32(str(i).encode()) % 10])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score(df, queries.common.id_remainder(F.col("doc_id"), 10) != 0, chunk_bytes=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = said[r["doc_id"]]
        want = sum(math.log10(p(w, tuple(ws[max(0, k - 2) : k]))) for k, w in enumerate(ws))
        assert math.isclose(r["score"], want, rel_tol=1e-9), r


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 300), st.sampled_from([64, 47, 9]))
@settings(max_examples=60, deadline=None)
def test_lists_are_read_back(values, most, width):
    import numpy as np

    values = np.sort(np.array(values, np.uint64) >> np.uint64(64 - width))
    counts = np.array([(7 * k) % (most + 1) * 10 ** (k % 4) for k in range(len(values))], np.int64)
    a, b = lm.read_list(lm.write_list(values, width, counts))
    assert (a == values).all() and (b == counts).all() and len(a) == len(values)


def test_ngrams_seen_once_are_held(spark):
    """However many tokens there are, and whichever chunks hold them."""
    filler = " ".join(f"w{k % 97}" for k in range(20_000))
    rows = [(k, filler) for k in range(10)] + [(20, "rare ngram here"), (40, "rare ngram here"), (41, "here ngram rare")]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 40, chunk_bytes=60_000).collect()}
    assert got[40] == got[20] > got[41] + 3


def test_model_beats_its_base(spark):
    rows = queries.QUERIES["op4_lm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# --- benchmark items


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_items_within_the_budget_are_found(data):
    item = data.draw(st.text("abcdefgh ", min_size=70, max_size=120))
    text = list(data.draw(st.text("abcdefgh ", max_size=80)) + item + data.draw(st.text("abcdefgh ", max_size=80)))
    for _ in range(data.draw(st.integers(0, 8))):
        at = data.draw(st.integers(0, len(text) - 1))
        kind = data.draw(st.sampled_from(["del", "ins", "sub"]))
        text[at : at + (kind != "ins")] = [] if kind == "del" else ["z"]
    text = "".join(text)
    a, b = decontam.normalise(item), decontam.normalise(text)
    hits = decontam.Index([(1, item)]).search(text)
    if len(a) >= decontam.Q:
        assert bool(hits) == (edits(a, b) <= decontam.budget(len(a)))


@pytest.mark.parametrize("m", [13, 25, 26, 38, 50, 63, 81, 88, 150, 217, 360, 1_000])
def test_items_with_eight_percent_of_edits_are_found(m):
    """Substitutions at even distances, which spoil the most q-grams."""
    random.seed(m)
    item = "".join(random.choice("abcdefghijklmnopq") for _ in range(m))
    for e, want in ((int(0.08 * m), True), (int(0.08 * m) + 1, False)):
        near = list(item)
        for k in range(e):
            near[(2 * k + 1) * m // (2 * e)] = "z"
        found = decontam.Index([(1, item)]).search(f"xyw {''.join(near)} wyx")
        assert [x[0] for x in found] == [1] * want and all(x[2] == e for x in found)


def test_short_items_are_searched_exactly():
    index = decontam.Index([(1, "To be"), (2, "o be"), (3, "x"), (4, "?!"), (5, "not to be,")])
    assert index.search("To be, or not to be: taxes") == [(1, 5, 0), (5, 18, 0)] and index.search("an X.") == [(3, 4, 0)]


def test_decontamination(spark, wide, nothing):
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_decontamination"](spark, SF).collect()}
    items = [(i, decontam.normalise(t)) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    rows = texts()
    assert len(found) == len(rows)
    for i, t in rows:
        exact = {k for k, s in items if s in decontam.normalise(t)}
        assert exact <= set(found[i]["item_ids"]) and found[i]["contaminated"] == bool(found[i]["item_ids"])
    items = spark.createDataFrame([(5, DOCS[0][1]), (5, DOCS[0][1]), (6, None), (7, "x"), (None, "of the of the of the of the")], "item_id long, text string")
    out = sorted((str(r["doc_id"]), r["item_ids"]) for r in decontam.find(wide, items).collect())
    assert len(out) == len(DOCS) and ("2", [5]) in out and ("3", []) in out and ("8", [-1]) in out
    assert decontam.keep(wide, items).count() == len(DOCS) - 5 and decontam.keep(wide, items.limit(0)).count() == len(DOCS)
    assert decontam.find(nothing, items).count() == 0


def test_blocks_of_items_add_up(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 60)
    items = spark.createDataFrame([(k, DOCS[0][1][k:]) for k in range(4)], "item_id long, text string")
    out = {r["doc_id"]: r["item_ids"] for r in decontam.find(docs, items).collect()}
    assert out[2] == [0, 1, 2, 3] and out[6] == []


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= set(before)
        rows = [(i, before[i]) for i in sorted(before)]
        if name == "near-duplicates":
            want = {int(i) for i, _, _, keep in brute_groups([r for r in rows], 5, 80) if keep}
            assert ids == want
        if name == "decontamination":
            items = [decontam.normalise(t) for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
            assert all(not any(s in decontam.normalise(before[i]) for s in items) for i in ids)
        before = {i: before[i] for i in ids}
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()) == sorted(kept.select("doc_id", "ids_sha256").collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_and_odd_documents(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in DOCS], schema)
    for df in (odd, odd.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, df, SF)
        assert out.columns == (df.columns if k < 4 else ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        assert out.count() <= df.count()


def test_one_row_of_a_repeated_document_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (3, a), (7, b), (7, b), (None, a), (None, c), (None, c), (9, None), (9, None), (None, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    want = [(3, a), (5, b), (None, c), (9, None), (None, None), (8, "")]
    assert out.columns == docs.columns and sorted(map(str, ((r[0], r[1]) for r in out.collect()))) == sorted(map(str, want))


def test_the_whole_pipeline_takes_odd_documents(spark, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    clean = [(100 + k, t, lang, None, None) for k, (t, lang) in enumerate(duckdb.sql(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL AND len(text) > 200").fetchall()[:60])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in DOCS] + clean, schema)
    for df in (odd, odd.limit(0)):
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(out) == (df is odd) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)


def test_lists_joined_by_chance_hand_out_no_sets(spark, monkeypatch):
    """Classes in one long chain of shared lists, without a pair near the threshold: none is dealt with its set."""
    rng = np.random.default_rng(5)
    sig = rng.integers(-(2**31), 2**31, (200, minhash.COORDINATES)).astype(np.int32)
    sig[1::2, 7], sig[2::2, 9] = sig[::2, 7], sig[1:-1:2, 9]
    node = rng.permutation(200).tolist()
    rows = [(node[k], 50, sig[k].tolist()) for k in range(200)]
    sized = spark.createDataFrame(rows, "node long, n long, sig array<int>")
    posted = spark.createDataFrame([(node[k], (c << 32) + int(sig[k, c])) for k in range(200) for c in (7, 9)], "node long, pair long")
    sets = spark.createDataFrame([(node[k], list(range(50 * k, 50 * k + 50))) for k in range(200)], "node long, s array<long>")
    counts, keep = {}, common.Scratch.keep

    def counted(self, df, name, **options):
        out = keep(self, df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    links = minhash._between(posted, None, sized, sets, common.Scratch(spark, "chain"), 39, 85)
    assert links is None or links.isEmpty()
    assert counts["open"] > 0
    assert counts.get("members", counts.get("dealt", 0)) == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_classes_with_enough_equal_coordinates_share_a_band(percent):
    matches = minhash.least_matches(percent)
    stretches = minhash.bands(matches)
    assert [x for start, end in stretches for x in range(start, end)] == list(range(minhash.COORDINATES))
    rng = np.random.default_rng(6)
    for _ in range(2000):
        equal = np.isin(np.arange(minhash.COORDINATES), rng.permutation(minhash.COORDINATES)[:matches])
        assert any(equal[start:end].all() for start, end in stretches)


def test_a_pair_counts_in_its_first_common_band(spark):
    matches = 39
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 2**31, (2, minhash.COORDINATES)).astype(np.int32)
    sig[1, -matches:] = sig[0, -matches:]

    def block(k):
        return minhash._Block(pa.array([{"node": k, "comp": k, "n": 50, "sig": sig[k].tolist()}], pa.struct([("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("sig", pa.list_(pa.int32()))])))

    first = next(i for i, (start, _) in enumerate(minhash.bands(matches)) if start >= minhash.COORDINATES - matches)
    met = {i: minhash._meet(block(0), block(1), i, matches, 85) for i in range(len(minhash.bands(matches)))}
    assert met == {i: {0, 1} if i == first else set() for i in met}


def counted_tables(monkeypatch):
    """Rows of each intermediate table, filled as they are written."""
    counts, keep = {}, common.Scratch.keep

    def counted(self, df, name, **options):
        out = keep(self, df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    return counts


def test_full_sets_only_where_signatures_meet(spark, monkeypatch):
    """Texts that share half of their words with either neighbour are in many lists, but near nothing: no set is made."""
    counts = counted_tables(monkeypatch)
    random.seed(9)
    parts = [" ".join(f"w{random.randrange(10**9)}" for _ in range(60)) for _ in range(81)]
    rows = [(i, f"{parts[i]} {parts[i + 1]}") for i in range(80)]
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80) == brute_groups(rows, 5, 80)
    assert counts["posted"] > 0
    assert counts["sets"] + counts.get("sets-met", 0) == 0


def test_rounds_of_tiles_lose_nothing_and_stay_small(spark, monkeypatch):
    """A family far larger than a round: the same groups, and no round deals more than a part of the tiles."""
    for name, value in (("TILE", 4), ("SIGNATURES", 4), ("SHINGLES", 10**6), ("LEAST_ROUND", 8000)):
        monkeypatch.setattr(minhash, name, value)
    random.seed(8)
    rows = [(i, " ".join([f"w{k}" if random.random() > 0.05 else f"y{random.randrange(99)}" for k in range(50)])) for i in range(60)]
    dealt, deal = [], minhash._deal

    def counting(members, *rest):
        out = deal(members, *rest)
        dealt.append(out.agg(F.sum(F.size("block"))).first()[0] or 0)
        return out

    monkeypatch.setattr(minhash, "_deal", counting)
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85) == brute_groups(rows, 3, 85)
    assert len(dealt) > 2
    assert max(dealt) <= 2 * 8000


def rows_made(spark, run):
    """Rows that each join and each explosion of a plan made while run() ran, all of its queries together."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    listed = store.executionsList()
    before = max((listed.apply(k).executionId() for k in range(listed.size())), default=-1)
    run()
    bus.waitUntilEmpty()
    listed, out = store.executionsList(), Counter()
    for at in (listed.apply(k).executionId() for k in range(listed.size())):
        if at <= before:
            continue
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(k) for k in range(metrics.size())):
                if re.search("Join|Generate", node.name()) and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    name = re.sub(r"#\d+L?|Build\w+, |Broadcast|SortMerge|Shuffled|Hash", "", node.desc())
                    out[name] += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out


def test_rounds_do_not_join_a_family_again(spark, monkeypatch):
    """One family of four times as many classes, sixteen times as many tiles and eight rounds for one: four times the rows."""
    for name, value in (("SIGNATURES", 32), ("ROUND", 0), ("LEAST_ROUND", 2048)):
        monkeypatch.setattr(minhash, name, value)
    dealt, deal = [], minhash._deal
    monkeypatch.setattr(minhash, "_deal", lambda *args: dealt.append(1) or deal(*args))

    def made(n):
        sig = np.random.default_rng(11).integers(-(2**31), 2**31, (n, minhash.COORDINATES)).astype(np.int32)
        sig[:, :3] = 7
        sized = spark.createDataFrame([(k, 50, sig[k].tolist()) for k in range(n)], "node long, n long, sig array<int>")
        posted = spark.createDataFrame([(k, 7) for k in range(n)], "node long, pair long")
        sets = spark.createDataFrame([(k, [k]) for k in range(n)], "node long, s array<long>")
        dealt.clear()
        return rows_made(spark, lambda: minhash._between(posted, None, sized, sets, common.Scratch(spark, "rounds"), 39, 85))

    small, large = made(128), made(512)
    assert len(dealt) >= 8
    assert large
    assert {k: v for k, v in large.items() if v > max(6 * small[k], 2 * 512)} == {}


def test_turns_of_families_lose_nothing(spark, monkeypatch):
    """Many turns and rounds: the same groups, each class exploded once a family and side, and no block left behind."""
    from pathlib import Path

    for name, value in (("TILE", 8), ("SIGNATURES", 8), ("SHINGLES", 10**6), ("LEAST_ROUND", 1500), ("HELD", 0.5)):
        monkeypatch.setattr(minhash, name, value, raising=name != "HELD")
    counts, scratches, start = counted_tables(monkeypatch), [], common.Scratch.__init__
    monkeypatch.setattr(common.Scratch, "__init__", lambda self, *args: scratches.append(self) or start(self, *args))
    random.seed(12)
    rows = [(i, " ".join([f"w{k}" if random.random() > 0.05 else f"y{random.randrange(99)}" for k in range(50)])) for i in range(60)]
    got = []
    made = rows_made(spark, lambda: got.extend(found_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)))
    assert got == brute_groups(rows, 3, 85)
    assert sum(name.startswith("met/") for name in counts) > 2
    sides = [v for k, v in made.items() if "Generate explode(CASE WHEN (comp = main)" in k]
    assert sides
    assert sum(sides) <= 2 * (counts["families"] + counts["members"])
    assert not list(Path(scratches[0].root.removeprefix("file://")).glob("*-blocks/*"))


def test_batches_between_jvm_and_python_are_small(spark, monkeypatch):
    """Long texts and blocks of families reach a worker a few at a time, whatever the session's limits were."""

    def sizes(batches, **_):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["a", "b"])

    def seen(run):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        got = run().collect()
        return sum(r["a"] for r in got), max(r["a"] for r in got), max(r["b"] for r in got)

    monkeypatch.setattr(common, "_keep", sizes)
    texts = spark.range(3000).select(F.col("id").alias("a"), F.lit(7).cast("long").alias("b")).coalesce(1)
    assert seen(lambda: common.keep_rows(texts, None, "b"))[:2] == (3000, 1024)
    monkeypatch.setattr(common, "_rows", sizes)
    long = texts.select(F.repeat(F.lit("x"), 20_000).alias("text"))
    rows, _, most = seen(lambda: common.map_rows(long, None, pa.schema([("a", pa.int64()), ("b", pa.int64())])))
    assert rows == 3000
    assert most < 6 << 20

    members = spark.range(2000).select(F.lit(1).cast("long").alias("fam"), F.lit(0).alias("band"), F.col("id").alias("node"), F.col("id").alias("comp"), F.lit(1).alias("w"))
    classes = spark.range(2000).select(F.col("id").alias("node"), F.lit(50).cast("long").alias("n"), F.array_repeat(F.col("id").cast("int"), minhash.COORDINATES).alias("sig"))
    rows, _, most = seen(lambda: minhash._compare(members, classes, 64, sizes, minhash._LINK, common.Scratch(spark, "sizes"), "sizes", 1 << 20))
    assert rows == 2 * 32 * 32
    assert most < 6 << 20
