"""Nodes of web pages and their features.

A page becomes a tree of block elements; the inline content between two block borders is a leaf of its own with its
text.  Content that is never article text (scripts, styles, head, embedded objects, choice lists) is left out while parsing.
"""

from __future__ import annotations

import html
import re

import numpy as np

# ---- fixed values: the elements of HTML by their kind
PLAIN = frozenset("html body hr frameset marquee listing plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr area map col embed link meta param source track base nobr bgsound "
                    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle semantics annotation").split())
HIDDEN = frozenset(("script style template noscript iframe svg head title canvas audio video object applet textarea select option datalist "
                    "noframes noembed xmp button dialog").split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hgroup hr main menu nav ol p pre search section summary table ul").split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}}
#: Attribute tokens by what they speak for; a token counts for a group that it starts with a member of.
GROUPS = {
    "nav": "nav menu navbar breadcrumb crumb pagination pager toc tabs skip sitemap",
    "header": "header masthead banner topbar top logo branding brand",
    "footer": "footer foot copyright colophon bottom legal imprint",
    "side": "sidebar side aside rail widget related recommend popular trending more teaser promo infobox",
    "notice": "cookie consent notice alert popup modal overlay gdpr privacy toast message warning",
    "ad": "ad ads advert advertisement sponsor sponsored banner-ad dfp adsense outbrain taboola commercial",
    "form": "form search login signin signup register newsletter subscribe subscription contact input captcha",
    "comment": "comment comments reply replies discussion disqus respond feedback review reviews commentlist thread",
    "content": "content article post entry story main body text prose blog page maincontent articlebody",
    "meta": "meta byline author date share social tags tag category print caption credit rating",
    "hidden": "hidden invisible collapse screen sr offscreen none",
}
SHORT = frozenset("ad ads top side more tag tags date main body text page post none sr foot legal form".split())     # whole tokens only
# ---- end of fixed values

NAMES = list(GROUPS)
LEXICON = {t: i for i, g in enumerate(NAMES) for t in GROUPS[g].split()}
TAGS = ["#text", "p", "heading", "li", "list", "div", "section", "article", "nav", "aside", "header", "footer", "form", "table", "cell", "quote", "other"]
TAG_OF = {"#text": 0, "p": 1, **dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), 2), **dict.fromkeys("li dd dt".split(), 3),
          **dict.fromkeys("ul ol dl menu dir".split(), 4), "div": 5, "center": 5, "section": 6, **dict.fromkeys("article main".split(), 7), "nav": 8,
          **dict.fromkeys("aside".split(), 9), "header": 10, "footer": 11, **dict.fromkeys("form fieldset search legend".split(), 12),
          **dict.fromkeys("table thead tbody tfoot tr".split(), 13), **dict.fromkeys("td th".split(), 14),
          **dict.fromkeys("blockquote pre figure figcaption address details summary".split(), 15)}
TAG_BIT = len(NAMES)                              # masks: token groups, then kinds of tags

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")
PREFIXES = tuple(t for t in LEXICON if t not in SHORT)


class _Known(dict):
    """Attribute token to the bits of its groups, worked out once for each token."""

    def __missing__(self, token: str) -> int:
        mask = 1 << LEXICON[token] if token in LEXICON else 0
        if not mask:
            for known in PREFIXES:
                if token.startswith(known):
                    mask |= 1 << LEXICON[known]
        if len(self) < 100_000:
            self[token] = mask
        return mask


_KNOWN = _Known()


def attribute_mask(attributes: str) -> int:
    """Bits of the token groups that an element's attributes speak for."""
    mask = 0
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            mask |= 1 << NAMES.index("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                mask |= 1 << NAMES.index("hidden")
        elif name not in ("aria-hidden", "hidden"):
            for token in WORDS.findall(value):
                mask |= _KNOWN[token.lower()]
    return mask


class Nodes:
    """Nodes of several pages in page order, as parallel lists."""

    def __init__(self):
        self.page: list[int] = []
        self.parent: list[int] = []
        self.tag: list[int] = []
        self.own: list[int] = []
        self.above: list[int] = []
        self.depth: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.links: list[int] = []
        self.controls: list[int] = []
        self.images: list[int] = []
        self.role: list[int] = []                 # training pages: 1 article, 0 not, by the attribute data-role of an element

    def __len__(self):
        return len(self.page)

    def _add(self, page, parent, tag, own, role=-1) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(tag)
        self.own.append(own)
        self.above.append(0 if parent < 0 else self.above[parent] | self.own[parent])
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.text.append("")
        self.linked.append(0)
        self.links.append(0)
        self.controls.append(0)
        self.images.append(0)
        self.role.append(role if role >= 0 or parent < 0 else self.role[parent])
        return len(self.page) - 1

    def add_page(self, page: int, source: str) -> None:
        """Appends the nodes of a page: its root, then its blocks in order."""
        stack = [("#root", self._add(page, -1, 16, 0))]
        pieces: list[str] = []
        state = [0, 0, 0, 0, 0, 0]                # link depth's stack height + 1, linked chars, links, controls, images, role

        def flush():
            text = " ".join("".join(pieces).split())
            if text or state[3] or state[4]:
                at = self._add(page, stack[-1][1], 0, 0)
                self.text[at], self.linked[at], self.links[at] = text, min(state[1], len(text)), state[2]
                self.controls[at], self.images[at] = state[3], state[4]
            pieces.clear()
            state[1:5] = 0, 0, 0, 0

        def close(height):
            del stack[height:]
            if state[0] > height:
                state[0] = 0

        def write(raw):
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state[0]:
                state[1] += len(" ".join(text.split()))

        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                write(source[at:])
                break
            if m.start() > at:
                write(source[at:m.start()])
            at = m.end()
            if m.group(1):
                tag, attributes = m.group(1).lower(), m.group(2)
                if tag in HIDDEN:
                    if tag not in VOID and not attributes.endswith("/"):
                        at = self._skip(source, at, tag)
                    state[3] += tag in ("button", "select", "textarea")
                    pieces.append(" ")
                elif tag in INLINE or (tag not in TAG_OF and tag not in PLAIN and "-" not in tag):
                    if tag == "a":
                        state[0], state[2] = len(stack), state[2] + 1
                    elif tag == "input":
                        state[3] += 'type="hidden"' not in attributes
                    elif tag == "img":
                        state[4] += 1
                    if tag in ("br", "wbr", "img", "input"):
                        pieces.append(" " if tag != "wbr" else "")
                else:
                    flush()
                    if tag in CLOSES_P or tag in ENDED_BY or tag in ("hr", "body", "html"):
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] == "p":
                                close(k)
                                break
                            if stack[k][0] in ("td", "th", "table", "div", "section", "article", "li"):
                                break
                    if tag in ENDED_BY:
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] in HOLDS[tag]:
                                break
                            if stack[k][0] in ENDED_BY[tag]:
                                close(k)
                    if tag in VOID or tag in ("html", "body", "frameset"):
                        continue
                    own = 1 << (TAG_BIT + TAG_OF.get(tag, 16))
                    role = -1
                    if attributes:
                        own |= attribute_mask(attributes)
                        if "data-role=" in attributes:
                            role = int('data-role="1"' in attributes)
                    stack.append((tag, self._add(page, stack[-1][1], TAG_OF.get(tag, 16), own, role)))
            elif m.group(3):
                tag = m.group(3).lower()
                if tag == "a":
                    state[0] = 0
                elif tag in TAG_OF or tag in PLAIN or "-" in tag:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
        flush()

    @staticmethod
    def _skip(source: str, at: int, tag: str) -> int:
        """Where the content of an element that is left out ends; nested ones of the same kind count."""
        end = re.compile(rf"</{tag}\s*>" if tag in RAW else rf"<(/?){tag}\b[^>]*>" + (r"|<body\b" if tag == "head" else ""), re.I)
        open_ones = 1
        for m in end.finditer(source, at):
            if tag in RAW:
                return m.end()
            if tag == "head" and not m.group().startswith("</"):
                return m.start()
            open_ones += -1 if m.group(1) else (0 if m.group().endswith("/>") else 1)
            if not open_ones:
                return m.end()
        return len(source) if tag in RAW else at               # never ended: only raw text reaches to the end of the page


FEATURES = ["depth", "chars", "words", "sentences", "blocks", "links", "controls", "images", "link_share", "chars_per_block", "words_per_sentence",
            "digits", "upper", "page_share", "starts", "ends", "parent_share", "parent_links", "siblings", "place", "same_siblings", "before_chars",
            "after_chars", "before_links", "after_links", "sibling_chars", "sibling_links", "elements", "longest", "page_chars", "ended"]
WIDTH = len(FEATURES) + 3 * len(TAGS) + 2 * (len(NAMES) + len(TAGS)) + len(NAMES)


def features(nodes: Nodes) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each node: density of its subtree, depth, neighbours, attribute tokens and tags."""
    n = len(nodes)
    if not n:
        return np.zeros((0, WIDTH), np.float32)
    page, parent, tag = np.array(nodes.page), np.array(nodes.parent), np.array(nodes.tag)
    depth = np.array(nodes.depth, float)
    root = parent < 0
    # subtree ends: a node's subtree is consecutive
    end = np.arange(1, n + 1)
    for i in range(n - 1, -1, -1):
        p = nodes.parent[i]
        if p >= 0 and end[i] > end[p]:
            end[p] = end[i]
    leaf = np.zeros((n, 9))
    for i, t in enumerate(nodes.text):
        if t:
            leaf[i, :5] = len(t), t.count(" ") + 1, len(SENTENCE.findall(t)), sum(map(str.isdigit, t)) if len(t) < 400 else 0, sum(map(str.isupper, t)) if len(t) < 400 else 0
            leaf[i, 5] = 1
    leaf[:, 6], leaf[:, 7], leaf[:, 8] = nodes.linked, nodes.links, nodes.controls
    sums = np.concatenate([np.zeros((1, 9)), np.cumsum(leaf, axis=0)])
    sub = sums[end] - sums[:n]
    images = np.concatenate([[0], np.cumsum(nodes.images)])
    chars, words, sentences, digits, upper, blocks, linked, links, controls = sub.T
    up = np.where(root, np.arange(n), parent)
    first = np.maximum.accumulate(np.where(root, np.arange(n), 0))           # the root of each node's page
    whole = np.maximum(chars[first], 1)
    share = lambda a, b: a / np.maximum(b, 1)
    link_share = share(linked, chars)
    before, after = np.full(n, -1), np.full(n, -1)
    place, count, same = np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((np.arange(n), parent))
    order = order[~root[order]]
    if len(order):
        new = np.r_[True, parent[order][1:] != parent[order][:-1]]
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(order)])
        place[order], count[order] = np.arange(len(order)) - start[group], size[group]
        before[order[1:]] = np.where(new[1:], -1, order[:-1])
        after[order[:-1]] = np.where(new[1:], -1, order[1:])
        look = np.array(nodes.own)[order] * 32 + tag[order]
        _, kind, times = np.unique(np.c_[group, look], axis=0, return_inverse=True, return_counts=True)
        same[order] = times[kind.ravel()]
    beside = lambda v, at: np.where(at < 0, 0.0, v[at])
    longest = np.zeros(n)
    np.maximum.at(longest, up[~root], chars[~root])
    ended = np.array([t[-1:] in ".!?:;…\"”»)" and bool(t) for t in nodes.text], float)
    parent_chars, parent_linked = chars[up] - chars, linked[up] - linked
    columns = [depth, np.log1p(chars), np.log1p(words), np.log1p(sentences), np.log1p(blocks), np.log1p(links), np.log1p(controls), np.log1p(images[end] - images[:n]),
               link_share, np.log1p(share(chars, blocks)), share(words, sentences + 1), share(digits, chars), share(upper, chars), chars / whole,
               (sums[:n, 0] - sums[first, 0]) / whole, (sums[end, 0] - sums[first, 0]) / whole, share(chars, chars[up]), link_share[up], count, share(place, count - 1), same,
               np.log1p(beside(chars, before)), np.log1p(beside(chars, after)), beside(link_share, before), beside(link_share, after),
               np.log1p(share(parent_chars, count - 1)), share(parent_linked, parent_chars), np.log1p(end - np.arange(n)), share(longest, chars), np.log1p(whole), ended]
    bits = len(NAMES) + len(TAGS)
    own, above = np.array(nodes.own, np.int64), np.array(nodes.above, np.int64)
    inside = np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        p = nodes.parent[i]
        if p >= 0:
            inside[p] |= inside[i] | nodes.own[i]
    flags = [(m[:, None] >> np.arange(bits)) & 1 for m in (above, inside)]
    kinds = [t[:, None] == np.arange(len(TAGS)) for t in (tag, tag[up], tag[up[up]])]
    return np.concatenate([np.stack(columns, axis=1), *kinds, *flags, (own[:, None] >> np.arange(len(NAMES))) & 1], axis=1).astype(np.float32)
