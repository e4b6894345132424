"""Main-text extraction: parser, trees and decoding against plain versions, and pages whose article is known."""

import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rubricon.llm import dom, extraction
from rubricon.llm.common import table

SF = "/root/testdata/sf0.01"


def leaves(source):
    n = dom.Nodes()
    n.add_page(0, source)
    return [t for t in n.text if t]


@pytest.mark.parametrize("source, blocks", [
    ("<p>a  b\n c<p>d<br>e</p>f", ["a b c", "d e", "f"]),
    ("<script>var t='</p><p>x';</script><p>y</p>", ["y"]),
    ("<p>1 &lt; 2 &amp;&amp; 3 &eacute;&#233;&nbsp;x</p>", ["1 < 2 && 3 éé x"]),
    ("a < b > c", ["a < b > c"]),
    ("<!-- <p>no</p> --><p>yes<!-- open", ["yes"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ('<p title="x > y">t</p><p class="a>b</p>', ["t", 'b']),
    ("<div>a<div>b</article></div>c", ["a", "b", "c"]),
    ("<head><title>t</title><style>p{}</style></head><body>b", ["b"]),
    ("<p>a<b>b</p><p>c", ["ab", "c"]),
    ("<svg><text>no</text></svg><p>x<button>ok</button>y", ["x y"]),
    ("<select><option>one<option>two</select>rest", ["rest"]),
    ("<P>UP</P><script>never ended", ["UP"]),
    ("", []), ("   ", []), ("plain", ["plain"]), ("<", ["<"]), ("</", ["</"]), ("<p", ["<p"]),
])
def test_blocks(source, blocks):
    assert leaves(source) == blocks


def test_deep_and_long_pages():
    assert leaves("<div>" * 3000 + "x") == ["x"]
    assert leaves("<p>" + "w " * 300_000) == [("w " * 300_000).strip()]
    assert leaves("<a href='" * 2000 + "x") is not None


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(2)
    for _ in range(80):
        n = rng.randrange(1, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        odds = [rng.gauss(0, 2) for _ in range(n)]
        inner = set(parent)
        texts = ["t" if i not in inner and rng.random() < 0.8 else "" for i in range(n)]

        def fits(c):
            return c[0] and all(not c[i] or (c[parent[i]] and (texts[i] or any(c[j] for j in range(n) if parent[j] == i))) for i in range(1, n))

        best = max((c for c in itertools.product([False, True], repeat=n) if fits(c)), key=lambda c: sum(o for o, k in zip(odds, c) if k))
        assert extraction.decode(parent, odds, texts) == list(best)


def composed(seed, n):
    rng, nodes = random.Random(seed), dom.Nodes()
    words = [f"w{rng.randrange(500)}" for _ in range(3000)]
    for i in range(n):
        nodes.add_page(i, extraction.compose(rng, words))
    return nodes


def test_trees_give_the_probabilities_of_the_fitted_model(spark):
    nodes = composed(1, 40)
    x, y = dom.features(nodes), extraction.holders(nodes)
    df = spark.createDataFrame([(r, float(v)) for r, v in zip(x.tolist(), y)], "x array<float>, label double").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=4, maxDepth=extraction.DEPTH, maxBins=16, stepSize=0.3).fit(df)
    want = np.array([r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()])
    got = 1 / (1 + np.exp(-extraction.Trees(model.toDebugString).log_odds(x)))
    assert np.abs(got - want).max() < 1e-9


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(table(spark, SF, "pages"))


def text_of(spark, model, sources):
    df = spark.createDataFrame([(i, "u", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    return [r["text"] for r in extraction.extract(df, model).orderBy("page_id").collect()]


def test_given_pages(spark, model):
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b), r["page_id"]


def test_composed_pages_of_other_seeds(model):
    nodes = composed(99, 300)
    want = extraction.holders(nodes)
    keep = np.array(extraction.decode(nodes.parent, model.log_odds(dom.features(nodes)), nodes.text))
    size = np.array([len(t) for t in nodes.text])
    hit, kept, true = size[keep & (want > 0)].sum(), size[keep].sum(), size[want > 0].sum()
    assert hit / kept > 0.97 and hit / true > 0.97


LONG = "The council met on Tuesday to discuss the plan for the old harbour, and most members spoke in favour of it. The vote is due next month."


@pytest.mark.parametrize("before, article, after", [
    ('<header class="site-header"><a href="/">News</a></header><nav><a href=a>Home</a> <a href=b>World</a></nav>', f"<main><h1>Harbour plan</h1><p>{LONG}</p><p>Short.</p></main>",
     '<aside><h3>Related</h3><ul><li><a href=c>Other story</a><li><a href=d>Another</a></ul></aside><footer>&copy; 2020 News. All rights reserved.</footer>'),
    ('<div id="cookie-banner"><p>We use cookies to improve your visit. By going on you accept them.</p><button>OK</button></div><ul class="menu"><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul>',
     f'<div class="post-content"><h1>Harbour plan</h1><p>{LONG}</p><ul><li>First point of the plan.</li><li>Second point of it.</li></ul><p>{LONG}</p></div>',
     f'<div id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>I think this is wrong. {LONG}</p></div><div class="comment"><b>Bo</b><p>Agreed.</p></div></div><div class="footer">Imprint</div>'),
    ('<div class="ad">Buy two, get one free. Only this week.</div>', f"<article><h1>Harbour plan</h1><p>{LONG}</p><p>{LONG}</p></article>",
     '<form class="newsletter"><label>Mail</label><input name=m><p>Subscribe to our letter.</p><button>Go</button></form><footer><a href=x>Contact</a></footer>'),
])
def test_written_pages(spark, model, before, article, after):
    got, = text_of(spark, model, [f"<html><head><title>t</title></head><body>{before}{article}{after}</body></html>"])
    assert got.split("\n") == leaves(article)


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(1, "u", None, "x", 1), (1, "u", None, "x", 1), (None, None, "", "x", 2), (2, None, "<nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>", "y", 3)],
                               "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(df, model).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, ""), (1, ""), (2, "")]
    long = "<article><h1>T</h1>" + f"<p>{LONG}</p>" * 6000 + "</article>"
    assert text_of(spark, model, [long])[0] == "\n".join(["T"] + [LONG] * 6000)


def test_empty_table_and_pages_without_words(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.main_text(none).collect() == []
    blank = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.main_text(blank).collect()] == [(1, "", 0)]
