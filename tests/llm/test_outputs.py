"""Token files, WARC archives, page text, scores and the pipeline."""

from __future__ import annotations

import gzip
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marquee.llm import html_text, lm_score, quality, rangecoder, tokens, toxicity, warc
from marquee.llm.queries import tokenizer_path

RNG = random.Random(3)


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("most", [1, 6, 49_407, 1 << 32])
def test_range_coder_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n)
    bits = rangecoder.id_bits(ids)
    blocks = rangecoder.encode(ids, bits)
    assert (rangecoder.decode(blocks, bits) == ids).all()
    if len(blocks) > 1:  # blocks stand alone
        assert (rangecoder.decode(blocks[1:2], bits) == ids[4096:8192]).all()


def test_range_coder_learns_and_detects_damage():
    ids = np.tile(np.arange(50), 80)
    (n, crc, payload), *rest = rangecoder.encode(ids, 16)
    assert not rest and len(payload) < n / 2
    with pytest.raises(rangecoder.CorruptBlock):
        rangecoder.decode([(n, crc, payload[:20] + bytes([payload[20] ^ 1]) + payload[21:])], 16)


TEXTS = [
    None, "", " ", "The end. It's 3.5 of n?!", "Ünïcode ΑΣ café é ﬁ x y", "a*. b.c 'd. x's.",
    "<|endoftext|> <|ENDOFTEXT|> A<|startoftext|>b.", "1.5 2. x!", "日本語 текст 🙂 . , .", "word " * 20_000,
]


def test_token_files(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(10 * i, t) for i, t in enumerate(TEXTS)]
    RNG.shuffle(rows)
    got = tokens.read_tokens(tokens.write_tokens(documents(rows), tokenizer_path())).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(rows), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert tokens.read_tokens(tokens.write_tokens(documents([]), tokenizer_path())).collect() == []
    twice = tokens.read_tokens(tokens.write_tokens(documents([(None, "a"), (4, "b"), (4, "b")]), tokenizer_path()))
    assert [(r.doc_id, r.start) for r in twice.orderBy("start").collect()] == [(None, 0), (4, 2), (4, 4)]


def test_warc(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "u", "<p>é</p>"), (2, "u", None), (4, "u", ""),
            (6, "u", "long " * 50_000), (None, "u", "once"), (7, "u", "7"), (7, "u", "7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS records")
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    key = {r.page_id: r for r in got if r.page_id != 7}
    assert {i: (r.record_type, r.refers_to) for i, r in key.items()} == {
        1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 2: ("revisit", 4), 4: ("response", None),
        6: ("response", None), None: ("response", None),
    }
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response", "revisit"]
    for i, _, html in rows[:6]:
        body = (html or "").encode()
        assert (key[i].payload_bytes, key[i].payload_digest) == (len(body), warc.digest(body))
        assert bytes(key[i].payload) == (body if key[i].record_type == "response" else b"")
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, least_revisit_bytes=10)).collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_warc_detects_damage():
    good = warc.record("response", "urn:page:1:0", None, b"payload", None)
    assert [r.headers["warc-type"] for r in warc.records(io.BytesIO(good * 3))] == ["response"] * 3
    plain = gzip.decompress(good)
    for bad in (
        good[:-9], good + b"x", gzip.compress(plain.replace(b"payload", b"pAyload")), gzip.compress(plain[:-4]),
        gzip.compress(plain + b"\r\n"), gzip.compress(b"no headers"),
    ):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


PAGES = [
    ("<article><header><h1>T&amp;C</h1></header><p>a&nbsp; b<br>c<p>d</p><div class='ad'>buy</div></article><footer>f</footer>", "T&C\na b c\nd"),
    ("<nav><a href=x>Home</a></nav><main><p>1 &lt; 2 <!-- > --> &#x41;</p><table><tr><td>x<td>y</table></main>", "1 < 2 A\nx\ny"),
    ("<main><script>if (a<b) '</p>'</script><p>t</p><form>f</form><ul class=comments><li>nice</ul><p hidden>h</p></main>", "t"),
    ("<article><p>" + "long text " * 30_000 + "</article>", ("long text " * 30_000).strip()),
    ("", ""), (None, ""), ("<p>a <b", ""), ("< & <3", ""),
]


LONG_LINE = "the river ran past the old mill and on towards the sea all day long"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><ul><li hidden>x<li>kept</ul>", "kept"),
        ("<article><ul><li class=ad>x<li>kept <ul><li>inner<li>more</ul> tail<li>last</ul>", "kept\ninner\nmore\ntail\nlast"),
        ("<article><ul><li hidden>x<div>y<li>kept</ul>", "kept"),
        ("<article><ul><li hidden>x<section><li>y</section></ul>z", "z"),
        ("<article><dl><dt hidden>x<dd>kept<dt class=ad>x<dd>also</dl>", "kept\nalso"),
        ("<article><table><tr hidden><td>x<tr><td hidden>y<td>kept<tr><th>also</table>", "kept\nalso"),
        ("<article><table><tr hidden><td>x<table><tr><td>y</table>z<tbody><tr><td>kept</table>", "kept"),
        ("<article><!-->a<!--->b<!-- x --!>c<!-- - -->d<!-- -- > x -->e", "abcde"),
        (f"<form id=aspnetForm><nav><a>m</a></nav><article><p>{LONG_LINE}</article><p>ok</form>", LONG_LINE),
        (f'<div class="layout sidebar-left"><article><p>{LONG_LINE}</article></div>', LONG_LINE),
        (f'<article><p>{LONG_LINE}</article><section class=comments><article><p>nice {LONG_LINE}</article></section>', LONG_LINE),
        (f'<article><p>{LONG_LINE}</article><div class=sidebar><article><p>teaser {LONG_LINE}</article></div>', LONG_LINE),
    ],
)
def test_html_of_implied_ends_and_wrappers(page, text):
    assert html_text.main_text(page, html_text.train()) == text


def test_html_time_grows_with_the_page():
    tree = html_text.train()
    for unit in ("<div>a</p>", "<button>", "<option>a", "<section><div><li>a</li>", "<table><tr><td>a", "<li><div>"):
        html_text.main_text(unit * 30_000, tree)  # minutes, where each tag looked through all that are open


def test_html_text(spark):
    rows = [(i, "u", h) for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = html_text.extract_text(pages).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [(t, len(t)) for _, t in PAGES]
    assert html_text.extract_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("attributes", "shown"),
    [
        ('class="article overflow-hidden"', True), ('style="overflow:hidden"', True), ('aria-hidden="false"', True),
        ("data-hidden", True), ("title='hidden display:none'", True), ("hidden=until-found", True),
        ("style='--x-display:none'", True), ("style='display:none;display:block'", True), ("id=hidden", True),
        ("hidden", False), ("class=a HIDDEN=''", False), ("aria-hidden=true", False), ("id='b'hidden", False),
        ("style='color: red; Display : none !important'", False), ("hidden=hidden/", False),
    ],
)
def test_only_hidden_elements_are_left_out(attributes, shown):
    tree, text = html_text.train(), "long text " * 20
    for page in (
        f"<article {attributes}><p>{text}</p></article>",
        f"<body><div {attributes}><article><p>{text}</p></article></div></body>",
    ):
        assert html_text.main_text(page, tree) == (text.strip() if shown else "")


def edits(a, b):
    """Edits between words, swaps of neighbours included (optimal string alignment)."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_agrees_with_edit_distance():
    terms, letters = ["stupid", "scum", "worthless"], "abcdeilmoprstuw"
    automaton, symbols = toxicity.build(terms), toxicity._symbols()
    for _ in range(1500):
        term = RNG.choice(terms)
        form = list(term)
        for _ in range(RNG.randrange(4)):
            at = RNG.randrange(1, len(form))
            form[at : at + RNG.randrange(2)] = RNG.choice([[], [RNG.choice(letters)]])
        form = "".join(form)
        near = [(edits(form, t), t) for t in terms if edits(form, t) <= toxicity.edits_allowed(t)]
        found = list(toxicity.find([form], automaton, symbols))
        # Edits before the second letter are not looked for.
        if found:
            assert (found[0][3], automaton.terms[found[0][2]]) == min(near)
        elif near and form not in toxicity.ORDINARY:
            assert form[:2] != min(near)[1][:2]


def test_automaton_allows_edits_at_every_letter():
    terms, rng = [*toxicity.SEED_TERMS], random.Random(5)
    automaton, symbols = toxicity.build(terms), toxicity._symbols()

    def hits(text):
        return [(automaton.terms[h[2]], h[3]) for h in toxicity.find([text], automaton, symbols)]

    for form, hit in {
        "xstupid": ("stupid", 1), "tupid": ("stupid", 1), "*diot": ("idiot", 1), "!diot": ("idiot", 0),
        "1diot": ("idiot", 0), "c1own": ("clown", 0), "scvm": ("scum", 1), "st!pid": ("stupid", 1),
    }.items():
        assert hits(form) == [hit], form
    assert hits("idiot!you stupid! moron!!") == [("idiot", 0), ("stupid", 0), ("moron", 0)]
    for _ in range(1500):
        form = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(2) if rng.random() < 0.5 else rng.randrange(len(form))
            form[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice("abcdeilmoprstuw")]])
        form = "".join(form)
        near = min(((edits(form, t), t) for t in terms if edits(form, t) <= toxicity.edits_allowed(t)), default=None)
        expected = [(near[1], near[0])] if near and form not in toxicity.ORDINARY else []
        assert hits(form) == expected, form


def test_toxicity(documents, spark):
    clean = ["the cat sat", "he used the word \"idiot\" here", "", None, "crown jewels " * 5_000]
    toxic = ["you idiot", "what a m0ron", "st*pid and wothless", "so disgsting of you", "an idoit " + "x " * 9_000]
    rows = [(i, t) for i, t in enumerate(clean + toxic + toxic)]
    labels = spark.createDataFrame([(i, 1, int(5 <= i)) for i in range(9)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents(rows), labels).collect()}
    assert [got[i].predicted for i in range(15)] == [0] * 5 + [1] * 10
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert got[1].quoted_hits == 1 and all(0 <= r.score <= 1 for r in got.values())
    unlabelled = toxicity.score_toxicity(documents([(None, "you idiot"), (3, "x")]), labels.limit(0)).collect()
    assert [r.predicted for r in sorted(unlabelled, key=lambda r: r.score)] == [0, 1]
    assert toxicity.score_toxicity(documents([]), labels).collect() == []


def test_quality(documents, spark):
    def text(good):
        words = [RNG.choice(["river", "stone", "Light", "morning", "we", "of"]) for _ in range(RNG.randrange(20, 90))]
        return " ".join(words) + "." if good else " ".join(w.upper() + RNG.choice(["!!", "$$$"]) for w in words)

    kinds = [RNG.random() < 0.7 for _ in range(400)]
    rows = [(i, text(k)) for i, k in enumerate(kinds)] + [(900, None), (901, ""), (902, "word " * 20_000)]
    labels = spark.createDataFrame([(i, int(k), 0) for i, k in enumerate(kinds[:200])], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(documents(rows), labels).collect()}
    right = [got[i].predicted == k for i, k in enumerate(kinds)]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    alone = quality.score_quality(documents([(1, "x"), (None, None)]), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in alone} == {(0.5, 1)}
    assert quality.score_quality(documents([]), labels).collect() == []
    assert 0.5 < quality.estimate_prior(np.arange(100.0), np.concatenate((np.arange(100.0), np.full(40, -9.0)))) < 0.85


@pytest.mark.parametrize("shard", [lm_score.SHARD, 700])
def test_lm_score(documents, spark, monkeypatch, shard):
    monkeypatch.setattr(lm_score, "SHARD", shard)
    rows = [(i, " ".join(RNG.choice("a b c d e Ä".split()) for _ in range(RNG.randrange(0, 9)))) for i in range(40)]
    rows += [(50, None), (51, "a b " * 5_000)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_lm(documents(rows), trusted).collect()}
    split = {i: [w.lower() if w.isascii() else w for w in (t or "").split()] for i, t in rows}
    sets = {"t": [i for i in range(0, 40, 3)], "b": list(split)}
    vocabulary = len({w for ws in split.values() for w in ws}) + 1
    everywhere = Counter(p for i in split for p in zip(["<"] + split[i], split[i], strict=False))
    for name, column in (("t", "target_loss"), ("b", "background_loss")):
        single = Counter(w for i in sets[name] for w in split[i])
        pair = Counter(p for i in sets[name] for p in zip(["<"] + split[i], split[i], strict=False))
        total = sum(single.values())
        for i, ws in split.items():
            loss = 0.0
            for p in zip(["<"] + ws, ws, strict=False):
                context = len(sets[name]) if p[0] == "<" else single[p[0]]
                seen = pair[p] if everywhere[p] >= lm_score.MIN_COUNT else 0
                bigram = seen / context if context else 1 / vocabulary
                loss -= math.log2(0.6 * bigram + 0.4 * (single[p[1]] + 1) / (total + vocabulary))
            assert got[i].n_tokens == len(ws)
            assert abs(got[i][column] - loss / max(1, len(ws))) < 1e-9
    assert lm_score.score_lm(documents([]), trusted).collect() == []
    assert len(lm_score.score_lm(documents([(None, "a"), (None, "a")]), trusted.limit(0)).collect()) == 2


def test_lm_score_keeps_every_word(documents, spark):
    # More words than 16-bit ids could name, all equally frequent, and one word found once.
    half = [" ".join(f"w{i}" for i in range(a, a + 1000)) for a in range(0, 70_000, 1000)]
    rows = list(enumerate([*half, *half, "w7 once"]))
    trusted = spark.createDataFrame([(0,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_lm(documents(rows), trusted).collect()}
    size, total, texts = 70_002, 140_002, 141

    def loss(pair, context, single, everything):
        return -math.log2(0.6 * (pair / context if context else 1 / size) + 0.4 * (single + 1) / (everything + size))

    # (In the first thousand words, w7 occurs three times.)
    inner = 999 - 2
    background = loss(2, texts, 2, total) + inner * loss(2, 2, 2, total) + loss(2, 2, 3, total) + loss(2, 3, 2, total)
    target = loss(1, 1, 1, 1000) + 999 * loss(1, 1, 1, 1000)
    assert abs(got[0].background_loss - background / 1000) < 1e-9 and abs(got[0].target_loss - target / 1000) < 1e-9
    assert abs(got[140].background_loss - (loss(0, texts, 3, total) + loss(0, 3, 1, total)) / 2) < 1e-9
    assert got[0].score < got[1].score


def test_pipeline_stages_keep_columns(spark):
    directory = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, directory)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        before = after
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
