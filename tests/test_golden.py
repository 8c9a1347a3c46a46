"""The hand-computed micro-corpus and edge cases."""

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import text as tx
from sparkseek.functions import urls
from sparkseek.operators import crawl, graph, search
from sparkseek.operators import index as ix

DOCS = [("A", "computer science is science"), ("B", "science of the computer. computer"), ("C", "the art"), ("D", "computer")]
EDGES = [("A", "B"), ("A", "C"), ("B", "A"), ("C", "C"), ("D", "A")]


@pytest.fixture(scope="module")
def index(spark):
    made = ix.Index.build(spark.createDataFrame(DOCS, "doc_id string, text string"))
    return ix.Index(made.postings.persist(), made.norms.persist(), made.freq.persist())


@pytest.fixture(scope="module")
def ranks(spark):
    return graph.pagerank(spark.createDataFrame(EDGES, "src string, dst string"), 3)


def test_index(index):
    hits = {(r["doc_id"], r["word"]): list(r["hits"]) for r in index.postings.collect()}
    assert hits == {("A", "computer"): [0], ("A", "science"): [1, 3], ("A", "is"): [2], ("B", "science"): [0], ("B", "of"): [1], ("B", "the"): [2], ("B", "computer"): [3, 5], ("C", "the"): [0], ("C", "art"): [1], ("D", "computer"): [0]}
    assert {r[0]: r[1] for r in index.norms.collect()} == {"A": 6, "B": 7, "C": 2, "D": 1}
    assert {r[0]: r[1] for r in index.freq.collect()} == {"computer": 3, "science": 2, "the": 2, "is": 1, "of": 1, "art": 1}


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    for n, want in {1: {"A": 1.7, "B": 0.65, "C": 1.35}, 2: {"A": 1.455, "B": 0.895, "C": 1.84}, 3: {"A": 1.6265, "B": 0.80925, "C": 2.09725}}.items():
        assert {r[0]: round(r[1], 6) for r in graph.pagerank(edges, n).collect()} == want
    warm = graph.pagerank(edges, 1, initial=graph.pagerank(edges, 2))
    assert {r[0]: round(r[1], 6) for r in warm.collect()} == {"A": 1.6265, "B": 0.80925, "C": 2.09725}


@pytest.mark.parametrize("query,want", [
    ("computer science", [("A", 8.615239), ("B", 1.180067), ("D", 0.0)]),
    ("art", [("C", 0.892843)]),
    ("the art", [("C", 11.379093), ("B", 0.0)]),
    ("of", [("B", 0.0)]), ("zzz", []), ("computer-science", []), ("", []),
    ("computer computer", [("B", 2 * 0.094442 * 0.80925 / 0.80925 * 0.80925), ("A", None), ("D", 0.0)]),
])
def test_search(index, ranks, query, want):
    scored = search.scores(index, ranks, tx.query_words(query)).collect()
    got = {r["doc_id"]: round(r["score"], 6) for r in scored}
    assert got.keys() == {d for d, _ in want}
    if query != "computer computer":
        assert sorted(got.items()) == sorted(want)
    else:
        assert all(0 <= v < 1 for v in got.values())


def test_paging(index, ranks):
    scored = search.scores(index, ranks, ["computer", "science"])
    ids = lambda df: [r["doc_id"] for r in df.collect()]
    assert ids(search.page(scored, 1)) == ["A", "B", "D"] and ids(search.page(scored, 99)) == []
    assert ids(search.page(scored, 1, strict=True)) == ["A", "B"] and search.total(scored).first()[0] == 3
    assert ids(search.page(scored, 1, size=2)) + ids(search.page(scored, 2, size=2)) == ["A", "B", "D"]
    with pytest.raises(ValueError):
        search.page(scored, 0)


def test_tokens_and_positions(spark):
    long = "x" * 30
    df = spark.createDataFrame([("a", "ñado word 3.14 u.s. It's " + long + " w" * 7)], "doc_id string, text string")
    posts = ix.postings(ix.word_positions(ix.tokenised(df)))
    got = {r["word"]: (r["count"], list(r["hits"])) for r in posts.collect()}
    assert got["word"] == (1, [1]) and got["w"][0] == 7 and len(got["w"][1]) == 5 and "ñado" not in got and "3.14" not in got
    assert long in got and long not in {r[0] for r in ix.doc_freq(posts).collect()}
    assert got["it"][1][0] > 3


def test_url_parts_and_links(spark):
    one = spark.range(1)
    part = lambda u: tuple(one.select(urls.parts(F.lit(u)).alias("p")).first()["p"])
    assert part("https://a.b:x/p") == ("a.b", 443, "/p", True) and part("http://a.b") == ("a.b", 80, "/", False) and part("http://a.b:81/") == ("a.b", 81, "/", False)
    to = lambda h: one.select(urls.resolve(F.lit("http://a.b/x/y.html?q#f"), F.lit(h))).first()[0]
    assert [to(h) for h in ("z", "../z", "/z/../w/", "//c/d", "https://e/f", "#g", "?r", "mailto:a@b", "")] == ["http://a.b/x/z", "http://a.b/z", "http://a.b/w/", "http://c/d", "https://e/f", "http://a.b/x/y.html?q#g", "http://a.b/x/y.html?r", "", "http://a.b/x/y.html?q#f"]
    ok = lambda u: one.select(urls.is_valid(F.lit(u))).first()[0]
    assert ok("http://a.b/c") and not ok("no url") and not ok("ftp://a/b")


def test_crawl_rules(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 1.5\nUser-agent: bot\nCrawl-delay: 3"
    rules = crawl.robots_rules(spark.createDataFrame([("d", body)], "domain string, body string"))
    assert {r["user_agent"]: (list(r["disallow"]), list(r["allow"]), r["delay"]) for r in rules.collect()} == {"*": (["/private"], ["/private/open"], 2), "bot": ([], [], 3)}
    assert crawl.rules_for(rules, "bot").first()["delay"] == 3 and crawl.rules_for(rules, "else").first()["delay"] == 2
    one = spark.range(1)
    path = lambda p: one.select(crawl.path_allowed(F.lit(p), F.array(F.lit("/private")), F.array(F.lit("/private/open")))).first()[0]
    assert path("/private/open/x") and not path("/private/x") and path("/x")
    kind = lambda k: one.select(crawl.media_type_ok(F.lit(k))).first()[0]
    assert [kind(k) for k in ("text/html; charset=x", "image/svg+xml", "application/pdf")] == [True, True, False]
    size = lambda n: one.select(crawl.size_ok(F.lit(n), 2)).first()[0]
    assert [size(n) for n in (2097152, 2097153, -1)] == [True, False, True]


def test_link_graph(spark):
    long = "/" + "l" * 2048
    pages = spark.createDataFrame([(1, "http://a/1", f'<a href="/2">x</a><a href="/2">y</a><a href="{long}">z</a>'), (2, "http://a/2", "<p>none")], "page_id bigint, url string, html string")
    assert sorted(map(tuple, graph.link_graph(pages).collect())) == [(1, 2), (2, 2)]
    assert graph.page_links(pages).count() == 3 and graph.page_out_links(pages).count() == 1


def test_snippets_and_display(spark):
    one = spark.range(1)
    told = lambda html, q: one.select(search.snippet(F.lit(html), q)).first()[0]
    assert told("<p>first one</p><p>second words two</p>", "two, words") == "second words two"
    assert told('<meta name="description" content="a &amp; b"><p>x</p>', "zzz") == "a & b"
    assert told("<p></p><p>x <b>y</b></p>", "zzz") == "x y" and told("", "a") == "" and told("<p>a</p>", " ") == "a"
    shown = one.select(tx.highlight(F.lit("A b a.c ab"), ["a", "b", ""]), tx.truncate(F.lit("abcdef"), 3)).first()
    assert tuple(shown) == ("<b>A</b> <b>B</b> <b>A</b>.c ab", "abc...")
    assert one.select(tx.html_text(F.lit("<title>T</title><script>x</script><p>a<b>b</b>&lt;&amp;lt;<br>c"))).first()[0] == "T ab<&lt; c"
