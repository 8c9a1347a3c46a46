import html
import re
import time

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkseek.llm import html_train
from sparkseek.llm.html import blocks, extract, label, label_long, main_text, weights
from sparkseek.llm.queries import op2_html_extraction

from .hand_pages import PAGES

SMALL = "/root/testdata/sf0.001"


def article(page):
    """The article of the generated pages, whose layout is known."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_query_equals_known_articles(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()}
    rows = op2_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_held_out_accuracy():
    assert html_train.accuracy(weights(), pages=150, seed=12345) > 0.97


def test_gradients_equal_differences():
    source = html_train.Pages(1)
    x, mask = html_train.pad([html_train.vectors(source.sample()[0]) for _ in range(3)])
    x, y = x.astype(np.float64), (np.random.default_rng(0).random(mask.shape) < 0.5).astype(np.float64)
    p = {k: v.astype(np.float64) for k, v in html_train.start().items()}
    _, g = html_train.gradients(x, mask, y, p)
    for key, at in (("fh", (2, 7)), ("rh", (3, 50)), ("fb", (4,)), ("rx", (PATH_ROW := int(np.flatnonzero(x[0, 0])[0]), 5)), ("w", (9,)), ("s", (PATH_ROW,))):
        step, old = 1e-5, p[key][at]
        p[key][at] = old + step
        up = html_train.gradients(x, mask, y, p)[0]
        p[key][at] = old - step
        down = html_train.gradients(x, mask, y, p)[0]
        p[key][at] = old
        assert abs((up - down) / (2 * step) - g[key][at]) < 1e-4 + 0.02 * abs(g[key][at])


def test_hand_written_pages():
    wrong = total = 0
    for page, want in PAGES.values():
        got = main_text([page])[0].split("\n\n")
        wrong += len(set(want) ^ set(got))
        total += len(want)
    assert total > 40 and wrong <= 2


def test_chunks_of_a_long_page_label_alike():
    source = html_train.Pages(3)
    found = [b for _ in range(12) for b in source.sample()[0]]
    assert (label_long(found, weights(), chunk=17) == label([found])[0]).all()


def test_time_grows_with_the_length():
    for unit in ("<a ", '<a "', "<a x='>\" ", '<a ">" ', "<div><b>", "<!-- ", "<select>", "<title>x", "</b>", "<![", "<b>x</p>"):
        began = time.perf_counter()
        blocks(unit * (5_000_000 // len(unit)))
        assert time.perf_counter() - began < 20, unit


def test_depth_and_broken_elements():
    deep = "<nav><ul>" + "<span>" * 300 + "menu" + "</nav><article><p>text"
    assert [(b[0], b[2]) for b in blocks(deep)] == [("menu", ("<ul",)), ("text", ("<p",))]
    nested = blocks("<div class=a>" * 1000 + "x" + "</div>" * 1000 + "<p>y")
    assert [b[0] for b in nested] == ["x", "y"] and nested[0][1] and set(nested[1][1]).isdisjoint(nested[0][1])
    assert [b[0] for b in blocks("x <script src=https://a.b/>hid</script>y <select><option>a</select>z <svg><g>q</g></svg>w<p title=\"it's\">k<p title='a>b'>m<select><p>open")] == ["x y z w", "k", "m", "open"]
    assert [b[0] for b in blocks("<p>a<math><mi>x</mi><mo>=</mo></math>b<object>old</object><p><iframe src=x>c")] == ["ax=b", "c"]


def test_batches_label_alike():
    source = html_train.Pages(5)
    found = [source.sample()[0] for _ in range(20)] + [[]]
    assert all((a == b).all() for a, b in zip(label(found), [label([f])[0] for f in found]))


def test_parser():
    assert [b[0] for b in blocks("a<b>b</b>c&nbsp;&amp;lt; <br> d<p>e<script>var x='<p>no</p>'</script>f<!-- g --><li>h<li>i</ul> < 3 <a href='x>y'>j</a>")] == ["abc &lt; d", "ef", "h", "i", "< 3 j"]
    assert blocks("<p") and blocks("<!-- open") == [] and blocks("<script>open") == [] and blocks(None) == []


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<p>" + "long words here. " * 20_000, "x"), (2, "v", "<div>" * 5_000 + "deep words are here", "x"), (2, "v", "<<>><p a='><!", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == 5 and sum(r["n_chars"] == 0 for r in got) >= 2 and max(r["n_chars"] for r in got) == len(("long words here. " * 20_000).strip())
    assert extract(df.where(F.lit(False))).collect() == [] and main_text([]) == []
