"""Operators 1, 3, 5, 6, 7 and 10 against brute force, round trips and held-out labels."""

import zlib

import numpy as np
import pytest
import public_tokenizers

from askbase.llm import html_extract, license_scan, mixing, quality_model, token_counts, token_store
from askbase.session import scratch_path
from tests.llm.helpers import edge_docs, key, with_clashes

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def brute_tokens(rows):
    t, start, out = token_counts.load(WORD), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = scratch_path(spark, "t")
    token_store.write_tokens(docs, path, WORD, 2)
    want = brute_tokens([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert key(token_store.read_back(spark, path).collect()) == key(want)
    t = token_counts.load(WORD)
    few = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path, [3, 77, -5]).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert few == {i: t.encode(text[i], add_special_tokens=False).ids + [2] for i in (3, 77)}
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.select("dict_hash").distinct().count() == 1


def test_token_files_edge_cases(spark):
    docs = with_clashes(edge_docs(spark)).filter("doc_id is null or doc_id <> 3")
    path = scratch_path(spark, "t")
    token_store.write_tokens(docs, path, WORD, 2)
    got = token_store.read_back(spark, path).collect()
    want = brute_tokens([(r["doc_id"], r["text"]) for r in docs.collect()])
    pick = lambda rows: sorted((tuple(r)[0], *tuple(r)[2:]) for r in rows if r[0] is not None)
    assert pick(got) == pick(want) and len(got) == len(want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    empty = scratch_path(spark, "t")
    token_store.write_tokens(docs.limit(0), empty, WORD, 2)
    assert token_store.read_back(spark, empty).count() == 0


def test_piece_encoder_equals_library(spark, sf, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_PIECES", 300)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 200)
    e, t = token_store.PieceEncoder(WORD), token_counts.load(WORD)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["a" + chr(c) + "b. A" + chr(c) + " " + chr(c) for c in [*range(1, 0x400), 0x85, 0x1680, 0x2028, 0x3000, 0x4E2D]]
    texts += ["<|startoftext|>x <|endoftext|>.", "it's DON'T we'Ll 's", "x" * 300 + " y", "ΑΣ. İ ǅ ﬁ ß é"]
    for k in range(0, len(texts), 50):
        part = texts[k:k + 50]
        assert e(part) == [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(part, add_special_tokens=False)]


def test_word_counter_equals_library_on_every_character(spark, sf):
    t, count = token_counts.load(BYTE), token_counts.WordCounter(BYTE)
    whole = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    texts = [f"a{c} b{c}c\n{c}d {c} e{c}{c}" for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000, 7), 0x1F600, 0x10FFFF])]
    for k in range(0, len(texts), 2000):
        assert count(texts[k:k + 2000]) == whole(texts[k:k + 2000])
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n", "a  b", "a \n b", "\na", "a\n", " a", "a ", "a\n\nb", "x <|endoftext|> y", "<|endo", "it's we'll\nI'd 'S", "a\x00b c",
              "a\tb", "x" * 300 + " y", "1 22 333", "\u00a0a b", "a\u2028b c", "don 't 's"]
    assert count(texts) == whole(texts)
    count.known.clear()
    for x in texts:
        assert count([x]) == whole([x])


@pytest.mark.parametrize("chunk,overlap", [(64, 40), (300, 64), (1000, 256)])
def test_spliced_counts_equal_whole_counts(spark, chunk, overlap):
    texts = ["it's <|endoftext|> we'll see   \n\n  " * 90, "x" * 4000, "a" * 700 + " b" * 900, " " * 3000 + "z",
             "don't<|endoftext|>stop 1234 ---- ¿qué? ñandú " * 60, "中文字符" * 500, None, "", "short"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = token_counts.count_tokens(docs, BYTE, huge_chars=100, chunk_chars=chunk, overlap_chars=overlap)
    t = token_counts.load(BYTE)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in
            [*enumerate(texts), (0, texts[0])]]
    assert key(got.collect()) == key(want)


def test_counts_edge_cases(spark):
    docs = with_clashes(edge_docs(spark))
    t = token_counts.load(BYTE)
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False)))
            for r in docs.collect()]
    assert key(token_counts.count_tokens(docs, BYTE, huge_chars=2000, chunk_chars=900).collect()) == key(want)
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script>
</head><body><!-- <article>no</article> --><header class=top>Head</header><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="ad box">Buy</div><article><h1>Title &amp; more</h1><p><b>First&nbsp;one<br>line <i>x</i><p>Sec&ouml;nd &#169;
<aside>Side</aside><table><tr><td>a<td>b<tr><td>c</table><form><p>Mail</p></form><div id=comments><p>I like it</p></div>
</article><footer>&copy; Host</footer></body></html>"""


def test_page_with_article():
    assert html_extract.main_text(PAGE, None) == "Title & more\n\nFirst one line x\n\nSecönd ©\n\na b\n\nc"


def test_suffix_array_decides_unlabelled_blocks(spark):
    boiler = "<div>Welcome to our site where you find all the news of today</div>"
    rows = [(i, f"https://h.example/{i}", f"<body>{boiler}<p>Page {i} tells its very own story number {i} at length, only once here</p>"
             "<div>All of our terms apply to every visitor of this site at all times</div></body>") for i in range(4)]
    rows.append((9, "https://other.example/", rows[0][2]))       # alone on its host: nothing repeats
    rows += [(20, "https://c.example/a", "<p>the same copied page text on two urls of one host here</p>"),
             (21, "https://c.example/b", "<p>the same copied page text on two urls of one host here</p>")]
    rows += [(30, None, None), (31, "x", ""), (None, None, "<p>a"), (32, "", "<script>"), (33, "u", "<p title='a>b\">c</p> < d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(with_clashes(pages)).collect()}
    for i in range(4):
        assert got[i]["text"] == f"Page {i} tells its very own story number {i} at length, only once here"
    assert got[9]["text"].startswith("Welcome") and got[20]["text"] == got[21]["text"] != ""
    assert got[30]["text"] == got[31]["text"] == got[32]["text"] == "" and got[None]["text"] == "a"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pages_equal_plain_reading(spark, sf):
    """The generated pages hold their article in <article>: a reading with html.parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.on, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.on = True
            if tag in ("p", "h1", "h2"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag == "article":
                self.on = False
            if tag in ("p", "h1", "h2"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.on:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r["html"])
        p.close()
        assert got[r["page_id"]] == "\n\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


def test_rates_equal_plain_gradient_and_meet_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = docs.select("doc_id", docs["lang"].alias("domain")).filter("doc_id % 2 = 0")
    weights = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    rates, report = mixing.mixing_rates(docs, labelled, weights)
    rows = rates.collect()
    tok, p = np.array([r["n_tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    names = sorted(weights)
    c = tok @ p
    t = tok.sum() * np.array([weights[k] for k in names])
    r = np.ones(len(rows))
    for _ in range(report["rounds"]):
        r = np.maximum(0, r - p @ (((tok * r) @ p - t) / c))
    assert np.allclose(r, [x["rate"] for x in rows], atol=1e-6)
    assert all(abs(report["totals"][k] - report["targets"][k]) < 1e-3 * report["targets"][k] for k in names)
    lang = {x["doc_id"]: x["lang"] for x in docs.collect()}
    assert all(abs(sum(x["posterior"]) - 1) < 1e-9 for x in rows)
    mixed = mixing.repeat_to_rates(docs, rates, report)
    assert mixed.columns == docs.columns and {x["doc_id"] for x in mixed.select("doc_id").collect()} == set(lang)


def test_domains_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = mixing.fit_domains(docs, docs.select("doc_id", docs["lang"].alias("domain")).filter("doc_id % 2 = 0"))
    rows = mixing.domain_posteriors(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["doc_id"] % 2 and r["n_tokens"] > 5]
    right = [r for r in held if model["domains"][int(np.argmax(r["posterior"]))] == r["lang"]]
    assert len(held) > 400 and len(right) >= 0.95 * len(held)


def test_mixing_is_native_and_takes_edge_cases(spark):
    docs = with_clashes(edge_docs(spark))
    labelled = spark.createDataFrame([(5, "en"), (11, "en"), (10, "fr"), (None, "fr"), (6, None)], "doc_id long, domain string")
    rates, report = mixing.mixing_rates(docs, labelled, {"en": 0.5, "fr": 0.4, "xx": 0.1})
    rows = rates.collect()
    assert len(rows) == docs.count() and set(report["targets"]) == {"en", "fr"}
    assert not any(n in rates._jdf.queryExecution().executedPlan().toString() for n in ("Python", "Arrow", "Pandas"))
    assert all(r["rate"] >= 0 for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.repeat_to_rates(docs, rates, report).count() >= docs.count()
    none, report = mixing.mixing_rates(docs, labelled.limit(0), {"en": 1.0})
    assert {r["rate"] for r in none.collect()} == {1.0}
    assert mixing.mixing_rates(docs.limit(0), labelled, {"en": 1.0})[0].count() == 0


def test_quality_model_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.filter("doc_id % 3 > 0")
    model = quality_model.fit(docs, train)
    rows = quality_model.score(docs, model).join(labels, "doc_id").collect()
    bad = [r for r in rows if r["quality"] == 0]
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(r["p_junk"] >= 0.5 for r in bad) >= 0.9 * len(bad)
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(not r["kept"] for r in toxic) >= 0.6 * len(toxic)
    kept = quality_model.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in rows if r["kept"]} <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_one_reading_gives_what_two_give(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None), (3, 1), (3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    labels = labels.select("doc_id", "toxic").unionByName(odd)
    model = quality_model.fit(docs, labels)
    rows = quality_model.score(docs, model).collect()
    assert key(quality_model.fit_and_score(docs, labels).collect()) == key(rows)
    kept = quality_model.fit_and_keep(docs, labels)
    assert kept.columns == docs.columns
    assert key(kept.collect()) == key(docs.join(quality_model.score(docs, model).filter("kept").select("doc_id"), "doc_id").select(*docs.columns).collect())
    assert key(quality_model.fit_and_score(docs, labels.limit(0)).collect()) == key(quality_model.fit_and_score(docs, None).collect())


def test_scores_equal_a_plain_sum(spark, sf):
    """The scorer of the model written out: bias and weights of the features that a text has, and its votes' posterior."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(docs, labels)
    reader = quality_model.Reader(model["stems"])
    got = {r["doc_id"]: (r["p_junk"], r["p_toxic"]) for r in quality_model.score(docs, model).collect()}
    for r in docs.collect():
        n, junk, toxic, on = reader(r["text"])
        for p, task, votes in zip(got[r["doc_id"]], ("junk", "toxic"), (junk, toxic)):
            x = model[task]["bias"] + sum(model[task]["weights"].get(f, 0.0) for f in on)
            x = min(max(x, -30), 30)
            assert not n or abs(p - (1 / (1 + np.exp(-x)) + model[task]["posterior"].get(votes, 0.0)) / 2) < 1e-9
    long = reader("x" * 50 + " " + "y" * 41)[3]
    assert quality_model.hash30("x" * 50) in long and quality_model.hash30("^yyyy") in long


def test_quality_model_edge_cases(spark):
    docs = with_clashes(edge_docs(spark))
    model = quality_model.fit(docs)
    rows = quality_model.score(docs, model).collect()
    assert len(rows) == docs.count() and not any(r["kept"] for r in rows if r["doc_id"] in (0, 1, 2))
    assert quality_model.score(docs.limit(0), quality_model.fit(docs.limit(0))).count() == 0


def test_em_finds_labeller_accuracies():
    rnd = np.random.default_rng(4)
    bad = rnd.random(6000) < 0.2
    hit, false = np.array([0.9, 0.7, 0.5, 0.8]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = np.where(bad[:, None], rnd.random((6000, 4)) < hit, rnd.random((6000, 4)) < false)
    patterns, codes = {}, ["".join("1" if v else "0" for v in row) for row in votes]
    for c in codes:
        patterns[c] = patterns.get(c, 0) + 1
    post = quality_model.fit_labellers(patterns)
    assert np.mean([(post[c] > 0.5) == b for c, b in zip(codes, bad)]) > 0.95


def test_licenses(spark):
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "All rights reserved. And then it goes on, and on"), (3, None),
            (4, "This work is licensed under the GNU General Public License, version 3."),
            (5, "This work is licensed under the GNU General Public License, version 2."),
            (6, "this WORK is licensed under  the GNU General Public Licence, version 3"),
            (7, "Licensed under CC BY 4.0. x\nLicensed under CC BY-NC 4.0."), (8, "a licensed plumber has rights"), (9, ""),
            (None, "Released under the MIT License."), (1, "prose\nReleased under the MIT License.\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["line_no"], r["license"], r["exact"]) for r in
                  license_scan.scan_licenses(with_clashes(docs)).collect()))
    assert got == sorted([(1, 1, "MIT", True), (1, 1, "MIT", True), (2, 0, "all-rights-reserved", True), (4, 0, "GPL-3.0", True),
                          (5, 0, "GPL-2.0", True), (6, 0, "GPL-3.0", False), (7, 0, "CC-BY-4.0", True),
                          (7, 1, "CC-BY-NC-4.0", True), (-1, 0, "MIT", True)])
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    scan = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        assert scan(text)[0] == name and scan("Foo bar. " + text + " And more of it, then.")[0] == name


def test_licenses_equal_exact_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r["doc_id"], i, n) for r in docs.collect() for i, line in enumerate(r["text"].split("\n"))
            for n, t in license_scan.TEMPLATES.items() if t in line}
    got = {(r["doc_id"], r["line_no"], r["license"]) for r in license_scan.scan_licenses(docs).collect() if r["exact"]}
    assert got == want and want


def test_licenses_are_confirmed_in_the_order_of_saved_bytes(monkeypatch):
    asked, scan = [], license_scan.Scanner()
    real = license_scan.differences
    monkeypatch.setattr(license_scan, "differences", lambda tw, block: asked.append(" ".join(tw)) or real(tw, block))
    line = "This work is licensed under the GNU General Public License, version 3. All rights reserved."
    raw = line.encode()
    order = [name for _, name, _, _ in scan.ranked(raw, scan.plain(raw))]
    assert len(order) == len(license_scan.TEMPLATES) and order[0] == "GPL-3.0"
    assert scan(line)[0] == "GPL-3.0" and scan(line)[-1]
    assert asked == [" ".join(license_scan.words(license_scan.TEMPLATES["GPL-3.0"]))]


def test_licenses_in_long_lines():
    rnd, scan = np.random.default_rng(1), license_scan.Scanner()
    for size in (60, 300, 1200, 6000):
        for name, text in license_scan.TEMPLATES.items():
            prose = [f"w{i}" for i in rnd.integers(0, 5000, size)]
            at = int(rnd.integers(0, size))
            got = scan(" ".join([*prose[:at], text, *prose[at:]]))
            assert got is not None and (got[0], got[4], got[5], got[6]) == (name, 0, size, True)
    got = scan("the work under the license is free " * 900 + license_scan.TEMPLATES["GPL-3.0"].replace("version", "release"))
    assert got[0] == "GPL-3.0" and got[4] == 1


@pytest.mark.parametrize("page,want", [
    ("<article class='post has-sidebar'><p>Text</p></article>", "Text"),
    ("<div class='content-with-sidebar'><article><p>Text</p></article></div>", "Text"),
    ("<div id='search-page'><main><p>Text</p></main></div>", "Text"),
    ("<div class='sidebar'><p>Side</p><div role=main><p>Text</p></div></div>", "Text"),
    ("<div class='social'><article><p>Text</p></article></div>", "Text"),
    ("<main class=search><p>Text</p></main><div class=search><p>Find</p></div>", "Text"),
    ("<article><h1 class='article-header'>Title</h1><p>Text</p></article>", "Title\n\nText"),
    ("<article><header class='entry-header'><h1>Title</h1></header><p>Text</p></article>", "Title\n\nText"),
    ("<article><p>Text</p><div class='post-share'>Share</div><div class='cookie-banner'>Ok</div></article>", "Text"),
    ("<article><p>Text</p><article class=comment><p>Me too</p></article></article>", "Text"),
    ("<article><p>Text</p></article><div id=comments><article><p>Me too</p></article></div>", "Text"),
    ("<nav><main><p>Menu</p></main></nav><p>Text</p>", "Text"),
    ("<main hidden><p>Old</p></main><p>Text</p>", "Text"),
])
def test_class_words_do_not_lose_main_parts(page, want):
    assert html_extract.main_text(f"<html><body>{page}</body></html>", None) == want


def test_repeated_runs_decide_inside_an_article(spark):
    """An id that may be a slug is not enough: the block goes if it repeats under other articles of its host."""
    box = "<p id='newsletter-box'>Get our weekly letter with all the news of this site for free</p>"
    story = "<h2 id='social-history'>Social history</h2><p id='menu-planning'>Plan {0}: how cooks of house number {0} write a menu for one week</p>"
    rows = [(i, f"https://h.example/{i}", f"<article><h1>Story {i}</h1>{story.format(i)}{box}</article><footer>Host {i}</footer>") for i in range(3)]
    rows.append((7, "https://h.example/copy", rows[0][2].replace("Host 0", "Host 7")))               # a copied article keeps its text
    rows.append((8, "https://other.example/", f"<article>{story.format(8)}{box}</article>"))         # nothing repeats
    rows.append((9, "https://other.example/b", "<article><p>Text</p><p id='cookie-notice'>Cookies</p><p class='ad-slot'>Buy</p></article>"))
    rows += [(20 + i, f"https://c.example/{i}", f"<article>{story.format(0)}</article><footer>Side {i}</footer>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    letter = "Get our weekly letter with all the news of this site for free"
    plan = "Social history\n\nPlan {0}: how cooks of house number {0} write a menu for one week"
    for i, n in ((0, 0), (1, 1), (2, 2), (7, 0)):
        assert got[i] == f"Story {n}\n\n{plan.format(n)}"
    assert got[8] == f"{plan.format(8)}\n\n{letter}" and got[9] == "Text"
    assert got[20] == got[21] == plan.format(0)
    assert all(letter in html_extract.main_text(h, None) for i, _, h in rows if i in (0, 1, 2))      # the runs alone decide
