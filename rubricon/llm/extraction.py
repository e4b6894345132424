"""Main text of web pages by gradient-boosted trees over DOM-node features and hierarchical decoding.

There are no labelled pages, so training pages are composed: the words of a bounded sample of the pages (``SAMPLE``) are set anew in
layouts whose parts are known (menus, headers, sidebars, notices, adverts, forms, comments, footers, and articles in many dresses).
Spark fits boosted trees on their nodes.  Every page is then parsed where it is read; the trees give each node the
log-odds that it holds article text, and the best consistent choice is taken: a node can be kept only if its parent is, and only if it has
text or a kept child, so a kept node has kept ancestors and a dropped one no kept descendants.  A dynamic programme over the
tree finds the choice of the largest total likelihood.  The text of kept leaves is the result.

Defined results: a null or empty page, and one without article text, gives an empty text; null ids and urls and repeated
rows are kept as rows; whole pages are read, however long; unended tags, broken nesting and stray markup never fail; an empty
table has no rows and trains nothing; columns other than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import shipped, staged
from rubricon.llm.dom import Nodes, features
from rubricon.session import checkpoint_dir

SAMPLE = 800                     # pages whose words dress the training pages
COMPOSED = 1_600                 # training pages, as many of each page's words
TREES, DEPTH, BINS, STEP = 24, 5, 32, 0.3
SLICE = 1 << 21                  # characters of pages parsed at a time

# ---- fixed values: names that the composed pages use for their parts
DRESS = {
    "nav": (["nav", "div", "ul", "div", "menu"], ["nav", "menu", "main-menu", "navbar", "site-nav", "breadcrumb", "navigation", "pagination", "topnav"]),
    "header": (["header", "div", "header"], ["header", "masthead", "site-header", "banner", "topbar", "branding"]),
    "footer": (["footer", "div", "footer"], ["footer", "site-footer", "copyright", "page-footer", "colophon", "bottom-links"]),
    "side": (["aside", "div", "section"], ["sidebar", "aside", "widget", "related", "recommended", "popular-posts", "right-rail", "more-stories"]),
    "notice": (["div", "section", "div"], ["cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup", "privacy-notice", "cookie-banner"]),
    "ad": (["div", "aside", "div"], ["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "adsense", "banner-ad"]),
    "form": (["form", "form", "div"], ["search-form", "newsletter", "login", "subscribe", "signup-form", "contact-form"]),
    "comment": (["section", "div", "ol", "div"], ["comments", "comment-list", "discussion", "responses replies", "reader-comments", "disqus_thread", "reviews"]),
}
ARTICLE = ["<article>", "<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry">', '<div class="article-body">',
           '<div class="story">', '<section class="article">', '<div role="main">', '<div id="main">', "<div>", "<section>", '<td class="content">', ""]
# ---- end of fixed values


def compose(rng: random.Random, words: list[str]) -> str:
    """A page of known parts in the given words; elements that hold article text carry ``data-role="1"``, the others inside them 0."""
    from html import escape

    closed = rng.random() < 0.95               # an article that is never closed swallows what follows; that then has its names

    def say(low, high, stop=True):
        k = rng.randint(low, high)
        start = rng.randrange(max(1, len(words) - k))
        text = escape(" ".join(words[start:start + k]), quote=False)
        return text[:1].upper() + text[1:] + ("." if stop and rng.random() < 0.8 and text[-1:] not in ".;" else "")

    def link(low=1, high=3):
        return f'<a href="/{rng.randrange(999)}">{say(low, high, False)}</a>'

    def dressed(kind, inside):
        tags, names = DRESS[kind]
        tag = rng.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        bare = closed and rng.random() < (0.6 if plain else 0.12 if kind in ("nav", "footer") else 0.0)
        attribute = "" if bare else f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "site ", "js-", "c-"])}{rng.choice(names)}{rng.choice(["", "", "-1", " wide", "__box"])}"'
        if rng.random() < 0.15:
            inside = f"<div>{inside}</div>"
        return f'<{tag}{attribute} data-role="0">{inside}</{tag}>'

    def links(n):
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(link() for _ in range(n)) if style < 0.85 else "".join(f"<div>{link()}</div>" for _ in range(n))

    def part(kind):
        if kind == "nav":
            inside = links(rng.randint(2, 14))
        elif kind == "header":
            inside = rng.choice(["", f"<h1>{link()}</h1>", f"<div>{link()}</div>"]) + rng.choice(["", f"<p>{say(2, 10)}</p>", links(rng.randint(2, 8))]) or link()
        elif kind == "footer":
            inside = rng.choice([f"&copy; {say(1, 4)} &middot; {say(2, 14)}", f"<p>{say(3, 20)}</p>", links(rng.randint(2, 10)), links(4) + f"<p>&copy; 20{rng.randrange(10, 30)} {say(2, 8)}</p>"])
        elif kind == "side":
            heading = rng.choice(["", f"<h3>{say(1, 4, False)}</h3>", f"<h4>{say(1, 4, False)}</h4>"])
            inside = heading + rng.choice([links(rng.randint(3, 10)), "".join(f"<p>{say(5, 50)} {link()}</p>" for _ in range(rng.randint(1, 4))), f"<p>{say(8, 60)}</p>"])
        elif kind == "notice":
            inside = rng.choice([f"<p>{say(5, 40)}</p>", say(5, 40)]) + rng.choice(["", f"<button>{say(1, 2, False)}</button>", link()])
        elif kind == "ad":
            inside = rng.choice([say(2, 40), f"<p>{say(3, 40)}</p>", f'<img src="x.png">{link(1, 8)}', say(2, 12) + " " + say(2, 12)])
        elif kind == "form":
            inside = f"<label>{say(1, 3, False)}</label><input name=q>" + rng.choice(["", f"<p>{say(3, 20)}</p>", "<textarea></textarea>", "<select><option>a</select>"]) + f"<button>{say(1, 2, False)}</button>"
        else:
            one = rng.choice(['<div class="comment">', '<li class="comment">', "<li>", '<div class="reply">', "<article>", "<div>"])
            inside = rng.choice(["", f"<h2>{say(1, 3, False)}</h2>", f"<h3>{say(1, 3, False)}</h3>"])
            for _ in range(rng.randint(1, 8)):
                inside += one + rng.choice(["", f'<span class="author">{say(1, 2, False)}</span> ', f"<b>{say(1, 2, False)}</b>"]) + f"<p>{say(2, 90)}</p>" + rng.choice(["", link()]) + "</" + one[1:].split()[0].rstrip(">") + ">"
            if rng.random() < 0.3:
                inside += '<form class="respond"><textarea></textarea><button>ok</button></form>'
        return dressed(kind, inside)

    def paragraph():
        k = rng.random()
        long = rng.choice([(1, 3), (2, 12), (8, 60), (20, 120), (40, 250)])
        text = say(*long)
        if rng.random() < 0.15:
            text += f" {link(1, 4)} {say(2, 30)}"
        if k < 0.68:
            return f"<p>{text}</p>"
        if k < 0.76:
            return f"<p><b>{text}<br>"
        if k < 0.82:
            return f"<div>{text}</div>"
        if k < 0.87:
            return f"<h{rng.randint(2, 4)}>{say(1, 8, False)}</h2>"
        if k < 0.93:
            kind = rng.choice(["ul", "ol"])
            return f"<{kind}>" + "".join(f"<li>{say(1, 30)}</li>" for _ in range(rng.randint(2, 8))) + f"</{kind}>"
        if k < 0.96:
            return f"<blockquote>{rng.choice(['', '<p>'])}{text}</blockquote>"
        if k < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{say(1, 4, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        return f"<figure><img src=a.png><figcaption>{say(3, 20)}</figcaption></figure>"

    body = rng.choice(["", f"<h1>{say(2, 14, False)}</h1>", f"<h1>{say(2, 14, False)}</h1>", f"<h2>{say(2, 14, False)}</h2>"])
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 15, 30])):
        body += paragraph()
        if rng.random() < 0.06:
            body += part(rng.choice(["ad", "side", "form", "notice"]))
    opened = rng.choice(ARTICLE)
    tag = opened[1:].split()[0].rstrip(">") if opened else ""
    if opened:
        body = f'{opened[:-1]} data-role="1">{body}' + (f"</{tag}>" if closed else "")
    else:
        body = f'<div data-role="1">{body}</div>'
    if tag == "td":
        body = f"<table><tr><td>{part('nav')}</td>{body}</tr></table>"
    if rng.random() < 0.2:
        body += part("comment")
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f"<div{rng.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{body}</div>"
    if rng.random() < 0.05:
        body = ""                                             # a page without an article
    top = [part(k) for k in ("header", "nav", "notice", "ad", "form", "nav") if rng.random() < 0.4]
    bottom = [part(k) for k in ("side", "comment", "ad", "nav", "notice", "form") if rng.random() < 0.25]
    rng.shuffle(top)
    rng.shuffle(bottom)
    if rng.random() < 0.8:
        bottom.append(part("footer"))
    return f"<html><head><title>{say(2, 8)}</title></head><body>{''.join(top)}{body}{''.join(bottom)}</body></html>"


class Trees:
    """Boosted trees as arrays; gives log-odds."""

    def __init__(self, described: str):
        self.trees = []
        for block in re.split(r"\n\s*Tree \d+ ", described)[1:]:
            weight = float(re.match(r"\(weight ([^)]+)\)", block)[1])
            nodes: list[list] = []                            # feature, threshold, left, right, value
            open_nodes: list[int] = []
            for line in block.splitlines()[1:]:
                line = line.strip()
                if line.startswith("Else"):
                    continue
                if open_nodes and line:
                    above = nodes[open_nodes[-1]]
                    if above[2] < 0:
                        above[2] = len(nodes)
                    else:
                        above[3] = len(nodes)
                        open_nodes.pop()
                if line.startswith("If"):
                    f, t = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
                    nodes.append([int(f), float(t), -1, -1, 0.0])
                    open_nodes.append(len(nodes) - 1)
                elif line.startswith("Predict"):
                    nodes.append([0, np.inf, len(nodes), len(nodes), float(line.split(":")[1])])
            a = np.array(nodes, float)
            self.trees.append((weight, a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += weight * value[at]
        return 2 * out


def decode(parent: list[int], odds, texts: list[str]) -> list[bool]:
    """The likeliest consistent choice of nodes: a node is kept only if its parent is, and only if it has text or a kept child.
    Roots are always kept."""
    n = len(parent)
    gains, best, lead = [0.0] * n, [-np.inf] * n, [-1] * n     # positive gains of the children; the best of them and which it is
    gain = [-np.inf] * n
    for i in range(n - 1, -1, -1):
        below = gains[i] if texts[i] or best[i] > 0 else best[i]
        gain[i] = float(odds[i]) + below
        p = parent[i]
        if p >= 0:
            gains[p] += max(gain[i], 0.0)
            if gain[i] >= best[p]:
                best[p], lead[p] = gain[i], i
    keep = [False] * n
    for i, p in enumerate(parent):
        alone = p >= 0 and parent[p] >= 0 and lead[p] == i and not texts[p] and gain[i] > -np.inf      # the one that its kept parent needs
        keep[i] = p < 0 or (keep[p] and (gain[i] > 0 or alone))
    return keep


def holders(nodes: Nodes) -> np.ndarray:
    """1 for nodes of a composed page that hold article text, themselves or below them."""
    holds = np.array([r > 0 and bool(t) for r, t in zip(nodes.role, nodes.text)], float)
    for i in range(len(nodes) - 1, -1, -1):
        if holds[i] and nodes.parent[i] >= 0:
            holds[nodes.parent[i]] = 1.0
    return holds


def train(pages: DataFrame, sample: int = SAMPLE, composed: int = COMPOSED) -> Trees | None:
    """Trees fitted on ``composed`` pages set in the words of at most ``sample`` pages, chosen by a hash of their id and text
    (of equal ones, one); None if there are no pages."""
    checkpoint_dir(pages.sparkSession)                        # the fit cuts its own lineage there
    rows = pages.select(F.xxhash64(F.col("page_id").cast("string"), F.lit("compose"), "html").alias("h"), F.coalesce("html", F.lit("")).alias("html"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]      # hashes alone are put in order
    if last is None:
        return None
    some = staged(rows.where(F.col("h") <= last).dropDuplicates(["h"]).select("html"))
    n = some.count()
    each = -(-composed // n)
    parts = max(1, min(sample // 100, 12))

    def describe(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                read = Nodes()
                read.add_page(0, source)
                words = [w for t in read.text for w in t.split()] or ["text"]
                nodes, rng = Nodes(), random.Random(len(source) * 1_000_003 + len(words))
                for i in range(each):
                    nodes.add_page(i, compose(rng, words))
                x, y = features(nodes), holders(nodes)
                use = np.array(nodes.parent) >= 0
                yield pa.record_batch([pa.array(x[use].tolist(), pa.list_(pa.float32())), pa.array(y[use])], names=["x", "label"])

    rows = staged(some.repartition(parts).mapInArrow(describe, "x array<float>, label double"))
    fitted = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=13,
                           minInstancesPerNode=5).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    return Trees(fitted.toDebugString)


def extract(pages: DataFrame, model: Trees | None) -> DataFrame:
    """``(page_id, url, text)`` of every page; the blocks of the article are lines of ``text``."""
    shared = shipped(pages.sparkSession, model)

    def run(batches):
        trees = shared()
        for b in batches:
            sources = b.column(2)
            start, size = 0, 0
            lengths = pa.compute.utf8_length(sources).to_pylist()
            for i in range(len(sources) + 1):
                if i == len(sources) or (size and size + lengths[i] > SLICE):
                    if i > start:
                        nodes = Nodes()
                        for page, source in enumerate(sources.slice(start, i - start).to_pylist()):
                            nodes.add_page(page, source)
                        keep = decode(nodes.parent, trees.log_odds(features(nodes)), nodes.text)
                        texts: list[list[str]] = [[] for _ in range(i - start)]
                        for page, text, kept in zip(nodes.page, nodes.text, keep):
                            if kept and text:
                                texts[page].append(text)
                        yield pa.record_batch([b.column(0).slice(start, i - start), b.column(1).slice(start, i - start), pa.array(["\n".join(t) for t in texts])],
                                              names=["page_id", "url", "text"])
                    start, size = i, 0
                if i < len(sources):
                    size += lengths[i]

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text")).schema
    return rows.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """Trains on ``pages`` and extracts the main text of all of them: ``(page_id, url, text, n_chars)``."""
    return extract(pages, train(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
