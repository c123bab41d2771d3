"""Operators that judge rows one by one, against plain Python."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS
from tidemark.llm import bpe, chat, html, langid, license, ogg, queries, toxicity

SF = "/root/testdata/sf0.001"


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- Ogg


def slow_crc(data):
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


@given(st.binary(max_size=300))
@settings(max_examples=30, deadline=None)
def test_crc(data):
    assert ogg.crc(data) == slow_crc(data)


@given(st.binary(max_size=5000), st.sampled_from([1, 7, 40, 200]))
@settings(max_examples=30, deadline=None)
def test_media_round_trip(data, times):
    payload = ogg.pad(data.replace(b"\xff", b"") * times)
    media = ogg.encode(payload)
    assert ogg.decode(media)[0] == payload
    packets, streams = ogg.demultiplex(media)
    assert sorted(streams) == [1, 2]
    assert sorted(p.start for p in packets if p.start is not None) == [576 * k for k in range(len(payload) // 576)]


def test_corrupt_media_are_reported(spark):
    good = ogg.encode(ogg.pad(b"abc" * 50_000))
    bad = [good[:3000] + bytes([good[3000] ^ 1]) + good[3001:], good[:-9], good[9:], b"", None]
    rows = collected(ogg.read_media(spark.createDataFrame([(k, m) for k, m in enumerate([good, *bad])], "doc_id long, media binary")))
    assert [r["error"] is None for r in sorted(rows, key=lambda r: r["doc_id"])][:4] == [True, False, False, False]


def test_media_query(wide):
    rows = collected(ogg.digests(ogg.read_media(ogg.with_media(wide, "text").select("doc_id", "media"))))
    assert len(rows) == len(DOCS)
    want = {}
    for i, t in DOCS:
        b = (t or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        want[i] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]]


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODEC = bpe.Codec(bpe.load_ranks(queries.VOCABULARY), public_tokenizers.PATTERN)


@given(st.text(max_size=80) | st.text("ab the", max_size=300))
@settings(max_examples=150, deadline=None)
def test_bpe_matches_the_library(text):
    ranks = CODEC.ids.ranks
    enc = _encoding(ranks)
    packed = CODEC.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


_ENC = []


def _encoding(ranks):
    if not _ENC:
        _ENC.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _ENC[0]


def test_bpe_of_one_long_piece(reference):
    text = "a" * 3000 + "bcde" * 3000
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_query(wide, nothing, reference):
    rows = collected(bpe.digests(wide, queries.VOCABULARY, public_tokenizers.PATTERN))
    want = {i: reference.encode_ordinary(t or "") for i, t in DOCS}
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r["n_tokens"] == len(want[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()
    assert bpe.digests(nothing, queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


# --- chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool|x", "null", "a\\", "a|>b", "\\|>", "x<|end|>y", "<s>[INST] "]) | st.text("|>\\<[plba:", max_size=8), st.text(max_size=30) | st.sampled_from(["</s>", "\\</s>", "<\\/s>", "[INST] ok [/INST]", "<|end|>", "\\\\", "<<SYS>>\n"])), max_size=6))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.parse(formatted) == turns
    for r, t in turns:
        assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|<\|end\|>", chat.escape(t))


def test_chat_packs(spark):
    rows = [(k, t, r, x) for k in range(40) for t, (r, x) in enumerate([("system", "be brief"), ("user", f"hi {k % 3}"), ("assistant", f"yes {k % 5}"), ("user", None), (None, "?")][: 1 + k % 5])]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    words = (queries.VOCABULARY, public_tokenizers.PATTERN)
    packs = chat.pack(df, *words).cache()
    got = {r["conv_id"]: r for r in collected(chat.digests(chat.unpack(packs, *words)))}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((r or "null", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for p in packs.collect():  # attention reaches exactly the ancestors, positions follow the parent, loss is the assistant's
        nodes = p["nodes"]
        assert len(p["ids"]) == len(p["positions"]) == len(p["loss"]) == sum(n["end"] - n["start"] for n in nodes)
        for conv in p["conversations"]:
            turns = by[conv["conv_id"]]
            for depth, k in enumerate(conv["nodes"]):
                covered = [x for a, b in nodes[k]["attends"] for x in range(a, b)]
                assert covered == [x for j in conv["nodes"][:depth] for x in range(nodes[j]["start"], nodes[j]["end"])]
                span = slice(nodes[k]["start"], nodes[k]["end"])
                assert p["positions"][span] == list(range(len(covered), len(covered) + span.stop - span.start))
                learned = np.array([i for i, x in zip(p["ids"][span], p["loss"][span]) if x], "<u4").tobytes()
                assert CODEC.decode(learned).decode() == (chat.escape(turns[depth][1]) if turns[depth][0] == "assistant" else "")
    assert sum(len(p["nodes"]) for p in packs.collect()) < len(rows)  # shared turns are emitted once a pack
    small = chat.pack(df.coalesce(1), *words, limit=20).collect()
    assert len(small) > 5 and sum(p["repeated"] for p in small) > 0
    packs.unpersist()
    assert chat.digests(chat.unpack(chat.pack(df.limit(0), *words), *words)).count() == 0


# --- licences


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(k, label) for phrase, label in license.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licences(spark):
    mit = dict(license.TEMPLATES)["mit-text"]
    texts = ["MIT License. mit license; CC-BY 4.0", mit.upper() + " é", mit.replace("free of charge", "wholly free of charge"), "mit the license", None, "", "GNU General\nPublic license", "cc by " * 3000, "Äpache license apacHe license"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])], "doc_id long, text string").withColumns({"tid": F.lit(1), "h": F.lit("x"), "n_words": F.lit(2)})
    rows = collected(license.scan(df))
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licences(texts[r["doc_id"] or 0])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["labels"] for r in rows}
    assert by[1] == by[2] == "mit-text" and by[3] == ""
    assert license.scan(df.limit(0)).count() == 0


def bands(text):
    """Labels of long templates and the best cover, by looking at every band of diagonals."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    labels, best = set(), 0.0
    for label, template in license.TEMPLATES:
        t = template.split()
        n = len(t) - 2
        for low in range(-n - license.NEAR, len(words)):
            got = {x for k in range(n) for p in range(low + k, low + k + license.NEAR + 1) if p >= 0 and words[p : p + 3] == t[k : k + 3] for x in (k, k + 1, k + 2)}
            if len(got) * 10 >= 9 * len(t):
                labels.add(label)
                best = max(best, len(got) / len(t))
    return labels, best


def test_long_templates_are_verified(spark):
    mit, bsd = dict(license.TEMPLATES)["mit-text"], dict(license.TEMPLATES)["bsd-text"]
    half = mit.split()
    texts = ["the software " * 30, "of the software and the software to deal in the software without " * 9, f"x {mit} y {bsd}", " ".join(half[14:] + half[:14]), " ".join(reversed(half)),
             " ".join(w for k, w in enumerate(half) if k != 9), " ".join(w for k, w in enumerate(half) if k % 9), mit.replace(" of ", " of all "), "licensed under cc by 4 0 " * 3]
    rows = collected(license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for r in rows:
        labels, best = bands(texts[r["doc_id"]])
        assert set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))) == labels
        assert r["score"] == (1.0 if r["n_base"] else best)
    by = {r["doc_id"]: (r["labels"], r["score"]) for r in rows}
    assert by[0] == by[1] == by[4] == by[6] == ("", 0.0) and by[2][0] == "bsd-text,mit-text" and by[5][0] == "mit-text" and by[8][0] == "cc-by,cc-by-4.0"


# --- pages

PAGES = {
    "<html><body><nav><a>Home</a></nav><article><h1>Title &amp; more</h1><p>First   para\n of text with some words.<p>Second &eacute;<br>line.<aside>see also</aside></article><section class='comments'><p>I disagree with all that was said here.</p></section><footer>(c)</footer></body></html>": "Title & more\nFirst para of text with some words.\nSecond é line.",
    "<body><div id=header>Site name</div><div class='sidebar'><p>About us and other things</p></div><div id=content><h2>Head</h2><div>One long paragraph of real text that goes on.</div><div>Sh.</div><form>Name <input></form></div><div class='cookie-notice'>We use cookies on this site, please accept them all now.</div></body>": "Head\nOne long paragraph of real text that goes on.\nSh.",
    "<p>Only <b>this</b> text": "Only this text",
    "<script>var t='<p>x</p>';</script><style>p{}</style>": "",
    "": "",
    "<main><p>a</p><ul><li>b<li>c</ul><table><tr><td>d</td></tr></table></main>": "a\nb\nc\nd",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html.extract(page) == PAGES[page]


@pytest.mark.parametrize("times", [1, 5, 40, 400])
@pytest.mark.parametrize("frame", ["<body><div id=page>{}</div></body>", "<body>{}</body>"])
def test_title_and_lead_stay_however_long_the_body_is(times, frame):
    body = ["One long paragraph of real text that goes on for a good while. " * 3] * times
    page = frame.format(f"<h1>Title</h1><p>A lead.</p><div class=text>{''.join(f'<p>{b}</p>' for b in body)}</div>")
    assert html.extract(page) == "\n".join(["Title", "A lead.", *map(str.strip, body)])


def test_sibling_articles_are_all_kept():
    texts = ["The first article is the longer one of the two and goes on. " * 9, "The second one is short.", "And a third."]
    page = "<body><nav>Home</nav>" + "".join(f"<article><h2>Head {k}</h2><p>{t}</p></article>" for k, t in enumerate(texts)) + "<footer>(c)</footer></body>"
    assert html.extract(page) == "\n".join(x for k, t in enumerate(texts) for x in (f"Head {k}", t.strip()))


def test_class_words_do_not_drop_what_an_article_says():
    page = "<nav><a>Home</a></nav><article><h2 class='alert'>Head</h2><p class='share-price'>The price of shares rose.</p><div class='related-work'>Others did the same before.</div><div class='ad-slot'>Buy now, it is cheap.</div><div class=share>Tell friends</div><p>End of it.</p></article>"
    assert html.extract(page) == "Head\nThe price of shares rose.\nOthers did the same before.\nEnd of it."


def test_blocks_beside_the_heaviest_are_kept():
    body = "<div>A short intro.</div><div class=text>" + "<p>One long paragraph of real text that goes on and on.</p>" * 9 + "</div><div><p>A tail.</p></div>"
    got = html.extract(f"<body><p>First words.</p>{body}</body>").split("\n")
    assert got[:2] == ["First words.", "A short intro."] and got[-1] == "A tail." and len(got) == 12


def test_ratios_decide_on_menus(monkeypatch):
    menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>word{k}</a></li>" for k in range(9)) + "</ul></nav>"
    text = "".join(f"<p>Paragraph {k} of an article whose text is long enough.</p>" for k in range(6))
    plain = html.extract(f"{menu}<div>{text}</div>")
    assert "word" not in plain and plain.count("\n") == 5
    monkeypatch.setattr(html, "smooth", lambda v: [1.0] * len(v))
    assert html.extract(f"{menu}<div>{text}</div>").startswith("word0\nword1")


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=30))
@settings(max_examples=50, deadline=None)
def test_smoothing_and_threshold(values):
    weight = lambda i, k: np.exp(-((i - k) ** 2) / 2) if abs(i - k) <= 3 else 0.0
    n = range(len(values))
    want = [sum(weight(i, k) * values[k] for k in n) / sum(weight(i, k) for k in n) for i in n]
    assert np.allclose(html.smooth(values), want)
    assert np.isclose(html.threshold(want), min(np.mean(want), np.std(want)))


@given(st.text(max_size=60) | st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<![", "<![CDATA[x", "]]>", "<!--", "-->", "<!x>", "<nav>", "</nav>", "<a href='", "'>", "</", "<?", "a b", "&amp", "<br/>", "<script>", "</script>", "<article>", "</article>", "<li>", "<span hidden>", "</span>", "<td>", "<", ">", "é"]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_malformed_pages_never_raise(page):
    assert isinstance(html.extract(page), str)


@pytest.mark.parametrize("part", ["<div><p>some text", "<![", "<!--", "<a href='", "</x>", "<nav>", "<p><div>", "<span hidden>"])
def test_deep_and_broken_pages_take_linear_time(part):
    import time

    began = time.perf_counter()
    html.extract(part * 100_000)
    html.extract(part * 50_000 + "x>" + "</p>" * 50_000)
    assert time.perf_counter() - began < 30


def test_marked_sections_are_passed_over():
    assert html.extract("<p>aaa</p><![foo[bar]]><p>bbb</p>") == "aaa\nbbb" and html.extract("<![ x>") == ""


def test_pages_query(spark):
    rows = collected(queries.QUERIES["op9_html"](spark, SF))
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as unescaping

    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescaping.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert {r["page_id"]: r["text"] for r in collected(html.main_text(odd))} == {1: "", None: "x"}
    assert html.main_text(odd.limit(0)).count() == 0


# --- language


def test_language(spark, wide, nothing):
    rows = collected(queries.QUERIES["op10_language"](spark, "/root/testdata/sf0.01"))
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    content = {"en": b"the and of to in is that it was for on are with", "de": b"der die und das nicht ist ein mit von zu auf den"}
    found = collected(langid.identify(wide, content))
    assert len(found) == len(DOCS)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5, 11)) for r in found)
    foreign = spark.createDataFrame([(1, "漢字 仮名 文字"), (2, "the and of to in is that")], "doc_id long, text string")
    assert {r["doc_id"]: r["rejected"] for r in collected(langid.identify(foreign, content))} == {1: True, 2: False}
    assert langid.learn(nothing, F.lit(True)) == {}
    assert langid.identify(nothing, {}).count() == 0


def test_sizes_match_plain_zstandard():
    """The least sum over blocks and, where that is narrow, over blocks after stretches of the dictionary."""
    import zstandard

    random = np.random.default_rng(2)
    letters = {"a": "abcde ", "b": "abcdf ", "c": "vwxyz "}
    content = {k: "".join(random.choice(list(v), 9_000)).encode() for k, v in letters.items()}

    def size(data, name, level):
        return len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False).compress(data))

    model, narrow = langid.Classifier(content), 0
    for k in range(60):
        text = "".join(random.choice(list(letters["abc"[k % 3]]), int(random.integers(1, 5_000))))
        if not text.strip():
            continue
        data = " ".join(text.split()).encode()
        blocks = [data[i : i + langid.BLOCK] for i in range(0, len(data), langid.BLOCK)]
        found = sorted((sum(size(b, name, langid.LEVEL) for b in blocks), name) for name in content)
        if found[1][0] - found[0][0] < langid.NARROW * found[0][0]:
            narrow += 1
            cut = {n: [content[n].decode()[j * 1000 : j * 1000 + langid.STRETCH].encode() + b" " for j in range(1, 9)] for n in content}
            found = sorted((sum(size(x + b, n, langid.FINE) - size(x, n, langid.FINE) for b in blocks for x in cut[n]), n) for n in content)
        name, _, margin = model.classify(text)
        assert (name, margin) == (found[0][1], (found[1][0] - found[0][0]) / max(found[0][0], 1))
    assert 0 < narrow < 60


# --- toxicity


def test_grammar_weights():
    machine = toxicity.grammar([1.0] * toxicity.GRADES)

    def run(*symbols):
        state, total = 0, 0.0
        for s in symbols:
            state, _, w = machine.arcs[state, s]
            total += w
        return total + machine.final[state]

    insult, target, no, said, threat = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT
    assert run(insult) == 1.0 and run(target, insult) == run(insult, target) == 1.5
    assert run(no, insult) == 0.0 and run(insult, no) == 1.0 and run(said, insult) == 0.5
    assert run(threat) == 0.0 and run(threat, target) > 1.5 and run(target, threat) > 1.5 and run(target, 0) == 0.0


def test_toxicity(spark, wide, nothing):
    sf = "/root/testdata/sf0.01"
    rows = collected(queries.QUERIES["op2_toxicity"](spark, sf))
    assert len(rows) == 1000 and all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    score = {k: [r["score"] for r in rows if r["held_out"] and toxic.get(r["doc_id"]) == k] for k in (0, 1)}
    assert np.mean([(a > b) + (a == b) / 2 for a in score[1] for b in score[0]]) > 0.8
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(wide.select("doc_id", "text"), labels, F.lit(True))
    assert toxicity.rate(wide, model).count() == len(DOCS)
    empty = toxicity.learn(nothing, labels.limit(0), F.lit(True))
    assert toxicity.rate(nothing, empty).count() == 0 and toxicity.keep(wide, empty).columns == wide.columns


def test_scores_match_a_plain_reading_of_the_clauses(spark):
    """Lexicon, clauses, the five rules and the logistic model, without transducers."""
    import math

    words = {"zorb": toxicity.INSULT, "zorble*": toxicity.INSULT + 3} | {w: s for s, ws in ((toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.THREAT, toxicity.THREATS)) for w in ws}
    model = toxicity.Model(words, [1.0 + k / 4 for k in range(toxicity.GRADES)], [-3.0, 1.0, 0.5, 0.25, 0.125], [1.5, 0.25, -0.75, -0.25])

    def clause(said):
        insults = [k for k, s in enumerate(said) if s >= toxicity.INSULT]
        targets, threats = (any(s == x for s in said) for x in (toxicity.TARGET, toxicity.THREAT))
        total = sum(model.grades[said[k] - toxicity.INSULT] for k in insults)
        # a threat that follows a target is an insult to the rules after it
        first = next((k for k, s in enumerate(said) if s in (toxicity.TARGET, toxicity.THREAT)), None)
        turned, met = list(said), False
        for k, s in enumerate(said):
            if s == toxicity.THREAT:
                turned[k] = toxicity.INSULT if targets and any(x == toxicity.TARGET for x in said[:k]) else toxicity.OTHER if k == first else s
        met = targets and threats
        marks = [k for k, s in enumerate(turned) if s >= toxicity.INSULT]
        total += 1.5 * met
        total += 0.25 * (bool(marks) and targets)
        total -= 0.75 * any(turned[k] >= toxicity.INSULT and any(x == toxicity.NEGATION for x in turned[:k]) for k in marks)
        total -= 0.25 * (bool(marks) and any(s == toxicity.REPORT for s in said))
        return total

    vocabulary = ["zorb", "Zorbles", "you", "not", "said", "kill", "plain", "word", "they", "never"]
    random = np.random.default_rng(4)
    texts = [" ".join(random.choice(vocabulary, 6)) + "." for _ in range(300)]
    for t in texts:
        said = [words.get(w, words["zorble*"] if w == "zorbles" else 0) for w in t.lower().strip(".").split()]
        hot = any(s >= toxicity.THREAT for s in said)
        found = [x for x in [clause(said)] if hot and x > 0] if said.count(toxicity.THREAT) <= 1 else None
        if found is None:  # several threats in a clause: the first stands for them
            continue
        got = toxicity.Scorer(model).clauses(t)
        assert np.allclose(got, found), t
        z = -3.0 + sum(c * f for c, f in zip([1.0, 0.5, 0.25, 0.125], [math.log1p(sum(found)), max(found, default=0.0), math.log1p(len(found)), math.log1p(100 * sum(found) / (20 + t.count(" ")))], strict=True))
        assert np.isclose(toxicity.Scorer(model).score(t)[0], 1 / (1 + math.exp(-z)))


def test_copies_of_a_long_toxic_text_teach_once(spark):
    copied = " ".join(f"zq{k}rarely" for k in range(3_000))
    rows = [(k, f"you zorble number{k} and more", 1) for k in range(40)] + [(100 + k, f"a kind word{k} and more", 0) for k in range(60)]
    rows += [(1_000 + k, copied, 1) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert "zorb*" in model.lexicon and not any(w.startswith("zq1") and len(w) > 8 for w in model.lexicon)


def test_every_word_with_evidence_is_an_entry(spark):
    """As many as there are: 2,400 insults of as much evidence each."""
    insults = [f"{a}{b}{c}" for a in "qxzvkjyw" for b in "aeioubcdfghlmnprst" for c in "aeioubcdfghlmnprst"][:2_400]
    rows = [(k, f"number{k} " + " ".join(insults), 1) for k in range(5)] + [(10 + k, f"kind{k} words", 0) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert len(insults) == 2_400 and set(insults) <= model.lexicon.keys()


def test_licences_match_sql(spark):
    from tests.oracle import compare

    assert compare(spark, queries.QUERIES["op8_license"], queries.ORACLES["op8_license"], "/root/testdata/sf0.01") == 1000
