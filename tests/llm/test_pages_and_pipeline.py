import hashlib
import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from causeway.llm import html_text
from causeway.llm.html_text import blocks, main_text, minimum_cut
from tests.llm.rows import corpus, frame, words
from tests.llm.test_dedup import expected_components, expected_cut
from tests.llm.test_rules_and_mixing import brute_mix, expected_measures
from tests.llm.test_texts import expected_hits

WRAP = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{}</body></html>"


def test_article_without_its_surroundings():
    page = WRAP.format(
        '<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
        '<div class="ad">Buy now, only today.</div><div class="cookie-notice">We use cookies here.</div><article><h1>A title &amp; more</h1>'
        '<p>First   paragraph,\n with <b>bold</b> and <a href="x">a link</a> in it.<p>Second &lt;paragraph&gt; of the text<br>goes on.'
        '<ul><li>item one</li><li>item two</li></ul><!-- gone --><script>no()</script></article><aside><p>Related stories you may like.</p></aside>'
        '<form><label>Mail</label><input><button>Go</button></form><section id="comments"><p>I liked this article a lot, thanks for it.</p></section>'
        '<footer>&copy; example &middot; all rights</footer>')
    assert main_text(page).split("\n") == ["A title & more", "First paragraph, with bold and a link in it.", "Second <paragraph> of the text goes on.", "item one", "item two"]


def test_pages_without_an_article_element():
    page = WRAP.format('<div id="menu"><a href="/">Home</a> <a href="/x">More</a></div><div class="content"><p>A long first paragraph that says a good deal of things.</p>'
                       '<p>Short one.</p><p>A long third paragraph that says a good deal of things.</p></div><div class="sidebar"><p>Popular this week.</p></div>')
    assert main_text(page).split("\n") == ["A long first paragraph that says a good deal of things.", "Short one.", "A long third paragraph that says a good deal of things."]


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("<article><p><b>Title here.<br><p>Some text that is long enough to stay.</i></div></article>") == "Title here.\nSome text that is long enough to stay."
    assert len(blocks("<div>" * 3000 + "deep" + "</div>" * 10)) == 1
    assert main_text("<article><p>" + "word " * 200_000 + "</article>").count("word") == 200_000


def test_custom_elements_self_closed_drawings_and_open_heads_drop_nothing():
    one, two = "A first paragraph that says a good deal of things.", "A second paragraph that says a good deal of things."
    for between in ("<svg-icon name='x'></svg-icon>", "<video-js></video-js>", "<select-box>", "<title-bar></title-bar>", "<svg/>", '<svg viewBox="0 0 1 1"/>', "<math />",
                    "<svg width=16/><text>drawn</text></svg>", "<svg><path d='M0'/><text>drawn</text></svg>", "<script src='a/b'/>no()</script>"):
        assert main_text(f"<article><p>{one}</p>{between}<p>{two}</p></article>") == f"{one}\n{two}", between
    for head in ("<head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title>", "<head><style>p{}</style></head>", "<HEAD><link rel=x>\n<BODY class='a'>"):
        assert main_text(f"<html>{head}<article><p>{one}</p><p>{two}</p></article></html>") == f"{one}\n{two}", head
    assert [b.text for b in blocks(f"<head><title>T</title>\n{one}<p>{two}")] == [one, two]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=7), st.data())
def test_minimum_cut_is_minimal(gain, data):
    n = len(gain)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    links = [(a, b, data.draw(st.integers(0, 4))) for a, b in pairs]

    def cost(x):
        return sum(max(0, -g) if keep else max(0, g) for g, keep in zip(gain, x)) + sum(c for a, b, c in links if x[a] != x[b])
    assert cost(minimum_cut(list(map(float, gain)), links)) == min(map(cost, product([False, True], repeat=n)))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abp \n&;\"'=!-", max_size=80))
def test_no_markup_fails(page):
    main_text(page)


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", "<article><p>Some text that stays, as it is long.</p></article>", 5), (1, "u", None, None), (None, None, "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    assert got == [(1, "u", "", 0), (1, "u", "Some text that stays, as it is long.", 36), (None, None, "", 0)]
    assert html_text.extract(pages.where("page_id < 0")).collect() == []


def test_every_stage_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    passage = " ".join(f"q{rng.randrange(500)}" for _ in range(30))
    rows = corpus(3) + [(300, "lead " + passage + " tail " + " ".join(f"z{k}" for k in range(30)), "en", "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, now, seen = docs.columns, {r[0]: r for r in rows}, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(name)
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality rules":
            measured = {i: expected_measures(r[1]) for i, r in now.items()}
            want = {i for i, m in measured.items() if not (m[0] < 10 or 100 * m[4] > 20 * m[0])}
        elif name == "near-duplicates":
            want = {i for i, (_, c) in expected_components(list(now.values())).items() if i == c}
        elif name == "substring dedup":
            cut = {i: (n, gone, sha) for i, n, gone, sha in expected_cut(list(now.values()), 35)}
            want = {i for i, (n, gone, _) in cut.items() if gone < n or not n}
            assert sum(gone > 0 for _, gone, _ in cut.values()) > 3
            for i in want:
                assert hashlib.sha256(" ".join(words(got[i]["text"])).encode()).hexdigest() == cut[i][2]
                assert cut[i][1] or got[i]["text"] == now[i][1]
                assert got[i]["n_chars"] == len(got[i]["text"])
        elif name == "benchmark decontamination":
            hit = {x[0]: x[5] for x in expected_hits(list(now.values()), [(1, passage), (2, None)])}
            want = {i for i in now if not hit[i]}
            assert want < set(now)
        else:
            tokens, exponent = brute_mix(list(now.values()), 0.98, 4.0)
            want = set(now)
            most = max(tokens.values())
            for s, n in tokens.items():
                read = sum(r["n_tokens"] for r in docs.collect() if r["source"] == s)
                assert 0 <= (round(most * (n / most) ** exponent) if n else 0) - read <= max(len(words(r[1])) for r in now.values())
        assert set(got) == want, name
        if name != "source mixing":
            assert docs.columns == columns
            now = {i: (i, got[i]["text"], got[i]["lang"], got[i]["source"]) for i in got}
    assert seen == [n for n, _ in corpus_pipeline.STAGES]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_on_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", "has-sidebar with-sidebar no-comments search-results form-group header-fixed share-enabled hasSidebar page-wrapper".split())
def test_names_of_layout_and_state_say_nothing(name):
    body = "<p>The article has a first long paragraph, with several words.</p><p>It has a second long paragraph, with some more words.</p>"
    want = "The article has a first long paragraph, with several words.\nIt has a second long paragraph, with some more words."
    rest = "<nav><a href=a>Home</a></nav><div class='site-footer'>Copyright by us, all rights reserved.</div><div class='comment-list'><p>I do not agree with this at all.</p></div>"
    for page in (f"<body><div class='page {name}'><article>{body}</article>{rest}</div></body>", f"<body><div class='{name}'><div>{body}</div>{rest}</div></body>",
                 f"<body><article class='{name}'>{body}</article>{rest}</body>"):
        assert main_text(page) == want


def test_pages_without_a_tag_end_take_linear_time():
    assert main_text("<a " * 100_000).count("<a") == 100_000


def test_stages_keep_texts_that_share_an_id_apart(spark, tmp_path):
    rng = random.Random(6)
    one, two, three = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(60)) for c in "uvw")
    passage = " ".join(f"q{k}" for k in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, rows):
        out = dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, rows), str(tmp_path))
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    good, bad = (2, one, "en", "a"), (2, "x x x", "en", "a")
    assert run("quality rules", [good, bad, (3, two, "en", "a"), (4, three, "en", "a"), (None, two, "en", "a")]) == sorted([(2, one), (3, two), (4, three)])
    assert run("near-duplicates", [(1, two, "en", "a"), (2, two, "en", "a"), (2, three, "en", "a"), (2, three, "fr", "b"), (5, None, None, None)]) == [(1, two), (2, three), (5, None)]
    assert run("benchmark decontamination", [(2, one + " " + passage, "en", "a"), (2, one, "en", "a"), (None, passage, "en", "a"), (None, two, "en", "a")]) == sorted([(2, one), (None, two)], key=str)
    assert run("substring dedup", [(2, one + " " + passage + " " + two, "en", "a"), (2, three, "en", "a"), (3, passage, "en", "a")])[0][0] == 2
