"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into the runs of text between block-level tags. Each block has its word count
and link density, those of its neighbours before and after it, and what it stands in
(article or main part, navigation and the like, class and id names). A decision tree, grown
here by Gini impurity on the few labelled pages below, keeps or drops each block.

Character references are decoded, white space inside a block becomes one space, blocks join
by an empty line. Scripts, styles, templates, hidden parts and comments hold no blocks.
Defined results: null or empty html has empty text; markup left open ends with the page;
a `<` that begins no tag is text; the work grows with a page's length however broken its markup is; repeated rows and null ids each have their row.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import map_rows

# HTML element names by their role.
SILENT = frozenset("script style noscript template iframe svg math object head select textarea button canvas audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class and id names of parts beside the text.
SIDE_WORDS = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
                       "breadcrumbs sidebar side rail header masthead footer comment comments discussion reply replies respond notice notices "
                       "cookie cookies consent alert popup modal overlay newsletter subscribe signup share sharing social related recommended "
                       "widget toolbar pagination pager tags legal copyright login search".split())
# Last words of names of whole pages, words of names that tell a state, and words for a text.
WHOLE = frozenset("page layout site template theme".split())
STATES = frozenset("has no not with without".split())
TEXTS = frozenset("article entry post story".split())
# Words that name a part beside a text or its subject, and words of parts of a page's layout.
SUBJECTS = frozenset("legal social tags notice notices alert rail reply search login banner".split())
LAYOUT = frozenset("area bar block box buttons container content group icons inner left links list media outer panel right section "
                   "text top bottom wrap wrapper".split())
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
FIELDS = ("words", "links", "before_words", "before_links", "after_words", "after_links", "main", "side", "heading", "sentence")


def beside(attributes: str, within: bool = False) -> bool:
    """Whether a class, id or role name is that of a part beside the text: not of a page that has such a part, or of a text's own header.

    `within` a text, a word that can be its subject needs more than another word beside it: social-reform is no such part, social-links is.
    """
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if "=" in attributes else ""
    for name in names.split():
        parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        side = SIDE_WORDS.intersection(parts)
        if within and side <= SUBJECTS and not LAYOUT.union(side).issuperset(parts):
            continue
        if side and not WHOLE.intersection(parts[-1:]) and not STATES.intersection(parts) and not (side <= {"header"} and TEXTS.intersection(parts)):
            return True
    return False


def hidden(attributes: str) -> bool:
    return bool(attributes) and bool(HIDDEN.search(QUOTED.sub("", attributes)) or re.search(r"""style\s*=\s*["'][^"']*display\s*:\s*none|aria-hidden\s*=\s*["']?true""", attributes, re.I))


class Tags:
    """The tags of a page in order; each stretch of it is looked at a bounded number of times, however broken it is."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.lost: set[int] = set()  # quotes that begin values from which no end of a tag is reached

    def end(self, at: int) -> int:
        """Where the `>` stands that ends a tag from `at` on, outside of quotes; where there is none, the first one."""
        first, passed = at, []
        while at <= max(self.last.values()):
            m = SPECIAL.search(self.html, at)
            c, i = m.group(), m.start()
            if c == ">":
                return i
            passed.append(i)
            if i in self.lost or i >= self.last[c]:
                break
            at = self.html.index(c, i + 1) + 1
        self.lost.update(passed)
        return self.html.find(">", first)

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag from `at` on, without a name for comments and the like; None if there is none."""
        html = self.html
        while (i := html.find("<", at)) >= 0:
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(html), False, "", ""
            if i > self.last[">"]:
                i = html.find("<!--", i)  # nothing else is a tag from here on
                return (i, len(html), False, "", "") if i >= 0 else None
            m = NAME.match(html, i)
            if m:
                end = self.end(m.end())
                return i, end + 1, bool(m.group(1)), m.group(2).lower(), html[m.end():end]
            if html[i + 1:i + 2] in ("!", "?", "/"):
                return i, html.index(">", i) + 1, False, "", ""
            at = i + 1
        return None


def blocks(html: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in main part, beside it, heading) of each block, in page order."""
    out, stack, runs, linked = [], [], [], 0
    opened, tags = Counter(), Tags(html)
    silent = side = main = anchors = headings = 0

    def flush():
        nonlocal runs, linked
        if runs:
            words = "".join(runs).split()
            if words:
                out.append((" ".join(words), len(words), linked, main > 0, side > 0, headings > 0))
            runs, linked = [], 0

    def pop():
        nonlocal silent, side, main, anchors, headings
        tag, quiet, aside, inner = stack.pop()
        opened[tag] -= 1
        headings -= tag in HEADINGS
        silent, side, main, anchors = silent - quiet, side - aside, main - inner, anchors - (tag == "a")

    at = 0
    while at < len(html):
        m = tags.next(at)
        end = m[0] if m else len(html)
        if end > at and not silent:
            text = unescape(html[at:end])
            runs.append(text)
            if anchors:
                linked += len(text.split())
        if not m:
            break
        _, at, close, tag, attributes = m
        if not tag:
            continue
        if tag not in INLINE and not silent:
            flush()
        elif tag == "br" and not silent:
            runs.append(" ")
        if close:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag not in INLINE:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and opened["p"]):
                pop()  # a new block ends an open paragraph and what is open in it
        if tag == "li" and stack and stack[-1][0] == "li":
            pop()
        quiet = tag in SILENT or hidden(attributes)
        inner = tag in MAIN
        aside = tag in ASIDE or (tag == "header" and not main) or (not inner and tag not in ("body", "html") and beside(attributes, main > 0))
        if tag == "main" and not main:
            aside = -side  # the main part is beside nothing, whatever it stands in
        stack.append((tag, quiet, aside, inner))
        opened[tag] += 1
        headings += tag in HEADINGS
        silent, side, main, anchors = silent + quiet, side + aside, main + inner, anchors + (tag == "a")
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            end = html.find(">", stop.end()) if stop else -1
            if not quiet and tag != "title":
                runs.append(unescape(html[at:stop.start() if end >= 0 else len(html)]))
            at = end + 1 if end >= 0 else len(html)
            pop()
    flush()
    return out


def features(found: list) -> np.ndarray:
    """A row of FIELDS for each block."""
    n = len(found)
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] / b[1] for b in found], float)
    x = np.zeros((n, len(FIELDS)))
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
    x[:, 6:] = [[b[3], b[4], b[5], b[0][-1] in ".!?\"'”’"] for b in found]
    return x


#: Labelled pages: the small table that the tree is grown on. 1 keeps a block, 0 drops it.
LABELLED = [
    ("""<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li></ul></nav><div class="ad">Buy two lamps and pay for one only today.</div>
        <article><h1>Rain returns</h1><p>After three dry weeks the rain came back to the valley on Monday morning, and farmers were glad of it.</p>
        <p>More follows.</p><p>The <a href="/w">weather office</a> expects showers until the end of the week in most of the western districts.</p></article>
        <footer>All content by the valley paper, no reprints.</footer>""", [0, 0, 0, 1, 1, 1, 1, 0]),
    ("""<header><a href="/">The Daily Note</a><p>News since the year 1902, every day of the week and all year.</p></header>
        <main><h2>Short notes</h2><p>Yes.</p><p>It opened at nine.</p><aside>Readers also liked our long story about trains in the snow.</aside>
        <section id="comments"><p>I do not agree with this at all, my own train was late again last winter.</p></section></main>
        <form>Your address here <input></form>""", [0, 0, 1, 1, 1, 0, 0, 0]),
    ("""<div><a href="/1">Sports</a> <a href="/2">Money</a> <a href="/3">Travel</a> <a href="/4">Food</a></div>
        <div><h1>How bread is made</h1>Good bread needs flour, water, salt and a lot of time; most people only think of the first three of them.
        <p>The dough rests for a night in a cool place, and in the morning it is folded twice before it goes into the oven.</p>
        <p>It is done when it sounds hollow.</p><p>Let it cool down before you cut it, as the crumb still sets for about an hour.</p></div>
        <div><a href="/x">Contact</a> <a href="/y">Imprint</a></div><p>Copyright 2021</p>""", [0, 1, 1, 1, 1, 1, 0, 0]),
    ("""<div class="cookie-notice">We use cookies to make this page work better for all of our readers.</div><table><tr><td><a href="/q">Next page</a></td></tr></table>
        <p>The museum will stay closed until its roof has been mended, the town said in a short letter to all schools.</p>
        <p>Guided tours begin again in May, and tickets that were bought for April remain valid for the whole of the summer.</p>
        <ul><li><a href="/l1">Ten quiet museums to visit</a></li><li><a href="/l2">Old roofs and their stories</a></li></ul>""", [0, 0, 1, 1, 0, 0]),
    ("""<article><p>One.</p><p>A longer sentence stands here and tells a little of what had happened on that day.</p><h2>Later</h2><p>Two <a href="/k">links</a>.</p>
        <ul><li>first point</li><li>second point of the list</li></ul><div class="share">Share this with your friends and family</div>
        <p><a href="/source">Source of the figures</a></p></article><div class="sidebar"><p>Most read today</p><p>A man found his lost ring in a fish.</p></div>""",
     [1, 1, 1, 1, 1, 1, 0, 1, 0, 0]),
    ("""<article><h1>A short walk</h1><p>We went up.</p><p>Then we came down again by the old road.</p><p>Fine.</p></article>""", [1, 1, 1, 1]),
    ("""<main><p>Only one line</p></main>""", [1]),
    ("""<article><h1>The bridge</h1><p>They began in March with the two towers on the northern side of the river.</p><p>It was slow work.</p><p>Nobody complained</p></article>""", [1, 1, 1, 1]),
    ("""<main><h1>On time</h1><p>We left early.</p><p>The road was empty, and by noon we stood in front of the gate and waited for the keys.</p></main>""", [1, 1, 1]),
    ("""<article><p>It rained.</p><p>Still, all came.</p></article>""", [1, 1]),
    ("""<article><p>See <a href="/m">the map of all of the paths</a></p><p><a href="/more">More on this walk</a></p></article>""", [1, 1]),
    ("""<h1>The lake</h1><p>The lake froze early this year, and the ferry had to stop for the first time in many winters.</p>
        <p>People walk across it now, which the harbour master does not like to see at all, as he told us twice.</p>""", [1, 1, 1]),
    ("""<p><a href="/i">Index</a></p><p>Nobody knows who planted the tall trees along the road, but they are older than the houses behind them.</p>
        <p>They will be measured in spring.</p><p>Printed on Monday</p>""", [0, 1, 1, 0]),
    ("""<div class="layout has-sidebar"><article><header class="entry-header"><h1>The mill</h1></header><p>The old mill grinds again, after a winter in which its wheel was mended.</p>
        <p>Visitors may come on Sundays.</p></article><div class="sidebar"><p>Most read today</p></div></div>""", [1, 1, 1, 0]),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A tree of (field, limit, left, right) and 0 or 1 at its leaves; ties go to the earlier field."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut), low)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained():
    xs, ys = [], []
    for html, labels in LABELLED:
        found = blocks(html)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks and {len(labels)} labels: {[b[0] for b in found]}")
        xs.append(features(found))
        ys += labels
    return grow(np.concatenate(xs), np.array(ys, float))


def kept(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree == 1)
    f, cut, left, right = tree
    low = x[:, f] <= cut
    out = np.zeros(len(x), bool)
    out[low], out[~low] = kept(left, x[low]), kept(right, x[~low])
    return out


def main_text(html: str, tree) -> str:
    found = blocks(html)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, keep in zip(found, kept(tree, features(found))) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    tree = trained()

    def run(batch):
        texts = [main_text(h or "", tree) for h in batch.column(2).to_pylist()]
        return pa.table({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                         "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(own, run, "page_id long, url string, text string, n_chars long")
