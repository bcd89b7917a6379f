"""Pages, vectors and the pipeline against brute force on small tables."""

import numpy as np
import public_tokenizers  # noqa: F401
import pytest

import corpus_pipeline
from salesmatch.llm import htmltext, pivots

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="with-sidebar">
<header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content post-%d"><h1>Title &amp; more</h1><p>First para&nbsp;graph <b>bo</b>ld number %d.
<p>Second &lt;b&gt;   text, long enough to matter here.<aside>side</aside><div class="ad-box"><p>buy</div>
<p>Third one.</p><section class="comments"><p>nice!</p></section></div><div class="sidebar">Other</div></div>
<form><input>name</form><footer>foot<script>var a="</p>";</script></body></html>"""


def test_pages(spark):
    rows = [(i, "http://www.a.org:80/x", PAGE % (i, i), "extra") for i in range(6)] + [
        (10, None, "<p>Only this</p>", ""), (11, "http://b.org", None, ""), (12, "http://b.org", "", ""),
        (13, "odd", "a < b & c > d", ""), (14, "http://www.a.org/y", "<article><p>Other layout of the page, all of it.</article>", ""),
        (1, "http://www.a.org:80/x", PAGE % (1, 1), "again"),
        (15, "http://c.org", "<div>" * 300 + "deep" + "</div>" * 300 + "<!-- never closed", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for limit in (1000, 0):  # broadcast winners, joined winners
        got = {r.page_id: r for r in htmltext.main_text(pages, broadcast_hosts=limit).collect()}
        for i in range(6):
            assert got[i].text == (f"Title & more First para graph bold number {i}. Second <b> text, long enough to matter "
                                   "here. Third one.")
        assert [got[i].text for i in range(10, 16)] == ["Only this", "", "", "a < b & c > d",
                                                        "Other layout of the page, all of it.", "deep"]
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.main_text(pages).count() == len(rows)
    assert htmltext.main_text(pages.where("false")).count() == 0


def test_whole_article_around_its_core(spark):
    body = "Body sentence %d, which is the most of it. " * 20
    lead = ('<div class="top"><a href="/">Home</a> <a href="/n">News</a></div><article><h1>Title %d</h1><p>Lead %d.</p>'
            '<div class="body"><p>' + body + '</p></div></article><p>All pages say this.</p>')
    table = '<main><h2>Results %d</h2><p>Before it.</p><table><tr><td>' + body + '</td></tr></table><p>After %d.</p></main>'
    parts = '<article><section><p>' + body + '</p></section><section class="more"><p>Second part %d.</p></section></article>'
    text = lambda n: " ".join((body % ((n,) * 20)).split())
    rows = [(n, "http://lead.org/", lead % ((n,) * 22)) for n in range(4)] + [(3, "http://lead.org/", lead % ((3,) * 22))] * 9
    rows += [(10 + n, f"http://table{n}.org/", table % ((n,) * 22)) for n in range(2)]
    rows += [(20 + n, "http://parts.org/", parts % ((n,) * 21)) for n in range(3)]
    # Half of the article stands outside the winning path of its host.
    half = lambda n: body % ((n,) * 20)
    rows += [(30 + n, "http://half.org/", f'<article><div class="a"><p>{half(n)}</p></div></article>') for n in range(3)]
    rows += [(40, "http://half.org/", f'<article><div class="a"><p>{half(7)}</p></div><div class="b"><p>{half(8)}</p></div></article>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = {r.page_id: r.text for r in htmltext.main_text(pages, broadcast_hosts=limit).collect()}
        assert [got[n] for n in range(4)] == [f"Title {n} Lead {n}. {text(n)}" for n in range(4)]
        assert [got[10 + n] for n in range(2)] == [f"Results {n} Before it. {text(n)} After {n}." for n in range(2)]
        assert [got[20 + n] for n in range(3)] == [f"{text(n)} Second part {n}." for n in range(3)]
        assert got[40] == f"{text(7)} {text(8)}"


def test_text_after_odd_elements(spark):
    texts = {
        '<p>First para.</p><svg viewBox="0 0 1 1"/><p>Rest of the article here.</p>': "First para. Rest of the article here.",
        "<p>One</p><select><option>x<p>Two</p>": "One x Two",  # no end tag: the element ends at once
        "<p>One</p><svg><text>no</text></svg><p>Two</p>": "One Two", "<p>One</p><script>var x": "One",
        "<p>One</p><p class='social-history'>Two</p><p class='post-comments'>no</p><div class='ad-box 3'>no</div>": "One Two",
        "<p>a</p><b c='": "a <b c='", "<p>a</p><!-- open <p>b</p>": "a", "a <!-- b": "a"}
    for html, want in texts.items():
        assert htmltext.extract(html) == want, html


@pytest.mark.parametrize("html", [
    "<div>" * 10_000 + "deep text" + "</div>" * 10_000, ("<div>" * 1_200 + "deep text" + "</div>" * 1_200) * 2,
    "<a b='" * 150_000, "<a b='" * 150_000 + ">", "<section>x" * 60_000, "<div>" * 10_000 + "</section>" * 100_000,
    "<select>x" * 100_000, "<p>x</b>" * 100_000, "<" * 1_000_000, "<!--" * 200_000, "<a '>\"" * 150_000, "<ul><li>x" * 50_000,
    "<div class='a b c d>'>" * 30_000], ids=range(13))
def test_malformed_pages_take_linear_time(html):
    import time
    start = time.process_time()
    path = htmltext.vote(html)[0]
    htmltext.extract(html, path)
    assert time.process_time() - start < 4  # two parses of up to a megabyte


def test_the_host_overrules_a_page(spark):
    """A page with more discussion than article, in a container without a telling name: other pages of its host vote."""
    story = lambda n: " ".join(f"Story {n} sentence {k}, long enough to matter." for k in range(8))
    talk = lambda n: "".join(f"<p>Reader {n}-{k} says something else at some length, and more.</p>" for k in range(40))
    page = lambda n, more: f'<div class="story"><h1>Title {n}</h1><p>{story(n)}</p></div><div class="zone">{more}</div>'
    rows = [(n, "http://h.org/", page(n, f"<p>Reader {n} agrees.</p>")) for n in range(6)] + [(9, "http://h.org/", page(9, talk(9)))]
    rows += [(20, "http://alone.org/", page(20, talk(20)))]
    # Another template of the same host, without the winning path.
    rows += [(30, "http://h.org/", f'<main><p>{story(30)}</p></main>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    assert got[9] == f"Title 9 {story(9)}"
    assert "Reader 20-7" in got[20]  # nobody overrules a page alone
    assert got[30] == story(30) and got[0].startswith(f"Title 0 {story(0)}")


def test_words_of_a_page_match_another_parser():
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    rng = np.random.default_rng(3)
    parts = ["<p>", "</p>", "<div class=x>", "</div>", "<b>", "</b>", "one ", "t&amp;wo ", "<br/>", "<script>var a = '<p>';</script>",
             "<h2 id='q'>", "</h2>", "&#233;t ", "<!-- no -->", "<ul><li>", "</ul>", "<table><tr><td>", "</table>", "<img alt='a > b'>"]
    for _ in range(300):
        html = "".join(rng.choice(parts, 40))
        other = Words()
        other.feed(html)
        other.close()
        from salesmatch.llm import pagetree
        ours = [t for _, t, _ in pagetree.unmarked(pagetree.parse(html)[1])]
        assert "".join(" ".join(ours).split()) == "".join("".join(other.out).split()), html


def test_host_votes(spark):
    urls = [("http://WWW.A.org:80/x",), ("https://u:p@b.org/y?z",), ("//c.org",), ("nothing",), (None,)]
    df = spark.createDataFrame(urls, "url string")
    assert [r[0] for r in df.select(htmltext.host(df.url)).collect()] == ["a.org", "b.org", "c.org", "", ""]
    votes = spark.createDataFrame([("h", "p", 5), ("h", "p", 1), ("h", "q", 100), ("i", "b", 2), ("i", "a", 2)],
                                  "host string, path string, size long")
    assert sorted(tuple(r) for r in htmltext.winners(votes).collect()) == [("h", "p"), ("i", "a")]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 24))
    x[200:240] = x[7] + 0.15 * rng.normal(size=(40, 24))  # a group of near copies
    x[240:250] = x[200]  # exact copies
    x[250] = 0
    rows = [(i, [float(np.float32(v)) for v in row], 0, 1) for i, row in enumerate(x)]
    rows += [(300, None, 0, 1), (301, [], 0, 1), (302, [float("nan")] * 24, 0, 1), (303, [None] * 24, 0, 1),
             (304, [float("inf")] * 24, 0, 1), (305, [1.0, 0.0], 0, 1), (306, [2.0, 0.0], 0, 1), (307, [0.0, 2.0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, n int").repartition(3)
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    unit = np.array([r[1] for r in rows[:250]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(250))
    assert found >= 0.9 * near.sum()  # the index's recall
    assert all(got[i].n_links <= near[i].sum() for i in range(250))
    assert all(got[i].component_id == 7 for i in range(240, 250)) and got[7].kept and not got[245].kept
    for i in (250, 300, 301, 302, 303, 304, 307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[305].n_links, got[306].component_id) == (1, 305)
    assert pivots.near_duplicates(df.where("false")).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_spread_pivots_equal_the_plain_greedy_choice():
    rng = np.random.default_rng(0)
    x = unit(np.concatenate((rng.normal(size=(40, 8)), rng.normal(size=(20, 8)) * 0.05 + 1, rng.normal(size=(1500, 8)))))
    kept = []
    for v in x:
        if len(kept) < 90 and all(v @ k < 0.7 for k in kept):
            kept.append(v)
    assert np.allclose(pivots.spread(x, 90), kept) and len(pivots.spread(x[:0], 5)) == 0


@pytest.mark.parametrize("clusters", [0, 50])
def test_comparisons_grow_with_the_vectors(clusters):
    def of(n):
        rng = np.random.default_rng(1)
        x = rng.normal(size=(n, 16))
        if clusters:
            x = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] * 1.2 + x
        x = unit(x)
        return pivots.comparisons(x, pivots.spread(x[:4 * (n // pivots.PER_PIVOT)], n // pivots.PER_PIVOT))

    assert of(8000) < 6 * of(2000)


def test_lists_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 16)
    base = np.random.default_rng(4).normal(size=8)
    rows = [(i, [float(v) for v in base + 0.01 * np.random.default_rng(i).normal(size=8)]) for i in range(90)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links == 89 and r.component_id == 0 for r in got)


def prose(seed, words=90):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ta", "re", "no", "li", "su", "men"], rng.integers(1, 4))) for _ in range(words))


def test_pipeline_stages(spark):
    key = "0f3c9a7be1d24586ab90cd12ef34567890abcdef"
    rows = [(i, prose(i), "en", "s", len(prose(i))) for i in range(40)]
    rows += [(100, prose(3), "en", "s", 1), (101, prose(50) + f'\ntoken = "{key}"', "en", "s", 1), (102, None, "en", "s", None),
             (103, "too short", "en", "s", 9), (104, prose(60) + "\na line that two documents hold", "en", "s", 1),
             (105, prose(61) + "\nA line that two documents hold ", "en", "s", 1), (None, prose(70), "en", "s", 1),
             (100, prose(3), "en", "s", 1), (7, prose(80), "en", "other", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    columns = docs.columns
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "test_stage")
        if name != "packing":
            assert docs.columns == columns
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts["quality"]) == {*range(40), 100, 101, 104, 105, None}
    assert texts["line_dedup"][105] == prose(61) and texts["line_dedup"][104].endswith("two documents hold")
    assert texts["line_dedup"][100] == ""  # its only line stands in document 3
    assert set(texts["near_duplicates"]) == {*range(40), 100, 101, 104, 105, None}
    near = [r.text for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(
        [r for r in rows if r[1]], schema), "").where("doc_id = 7").collect()]
    assert sorted(near) == sorted([prose(7), prose(80)])  # one doc_id, two unrelated texts
    assert key not in texts["secrets"][101] and "[SECRET]" in texts["secrets"][101]
    assert {i: t for i, t in texts["secrets"].items() if i != 101} == {i: t for i, t in texts["near_duplicates"].items() if i != 101}
    assert {r.doc_id for r in docs.collect()} == set(texts["secrets"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stage_of_nothing(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0
