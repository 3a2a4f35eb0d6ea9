"""Main text of web pages: boosted trees over DOM-node features, decoded down the tree.

A page is parsed into elements and text runs. Gradient-boosted trees score each
node: does it hold main text? Features: size and density of its subtree, links
in it, tag, class and id words, depth, and how it stands among its siblings.
Decoding picks the best set in which a node is kept only under a kept parent,
by dynamic programming over the tree, so an ancestor and a descendant never
contradict each other.

The trees are trained here, on pages that `sample_page` writes in many
layouts with known main text; no page of the input is looked at.

Scale: a narrow map over pages with no shuffle; the model is a few kB.

Defined cases: null and empty html give an empty text; broken, unclosed and cut
off markup is read leniently to its end; repeated rows come out each; extra
columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import col, slices

# Element groups of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template head title textarea svg iframe select".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td blockquote pre figure figcaption nav header footer aside form button input label a span b dl dt dd #text".split()
#: Words of class, id and role; each is one feature, as a part of an attribute's words.
WORDS = "nav menu head foot side bar ad ads advert sponsor promo banner cookie consent notice alert popup modal newsletter subscribe share social comment repl discuss respons feedback thread related recommend breadcrumb widget login search form tag meta byline copyright legal pagination content main article post entry body text story page wrap container".split()

#: The words before this place speak of what surrounds a text, the others of the text; elements that surround.
BOILERPLATE, OUTER = WORDS.index("content"), set("nav header footer aside form button input label".split())
#: What it costs, in log odds, to part a dropped node from a kept parent.
PART = 1.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_ANY = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _hides(attributes: str) -> bool:
    """Whether an attribute of its own says so, not a part of another's value."""
    for a in _ANY.finditer(attributes):
        name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and _STYLE.search(value):
            return True
    return False


class Page:
    """Nodes in page order: tag (#text for a run), parent, text of runs, attribute words. `breaks` are places where a block ends."""

    def __init__(self, source: str):
        self.tag, self.parent, self.text, self.words, self.hidden = ["#root"], [-1], [""], [()], [False]
        stack = [0]
        raw = ""  # inside this element nothing is markup
        at, end = 0, len(source)
        while at < end:
            if raw:
                close = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                raw = ""
                stack.pop()
                continue
            m = _TOKEN.match(source, at)
            at = m.end()
            # an open quote doesn't reach beyond the end of its tag
            name, attributes = m[2] or m[4], m[3] or m[5] or ""
            if name:
                tag = name.lower()
                if tag == "p" or tag in CLOSES_P:
                    self._close(stack, "p", ("button", "td", "th", "table", "li", "body"))
                if tag == "li":
                    self._close(stack, "li", ("ul", "ol"))
                elif tag in ("td", "th"):
                    self._close(stack, "td", ("tr", "table"))
                    self._close(stack, "th", ("tr", "table"))
                elif tag == "tr":
                    self._close(stack, "tr", ("table",))
                elif tag in ("dt", "dd"):
                    self._close(stack, "dt", ("dl",))
                    self._close(stack, "dd", ("dl",))
                elif tag == "body":
                    self._close(stack, "head", ("body",))
                node = self._add(tag, stack[-1], "", attributes)
                if tag not in VOID and not attributes.endswith("/"):
                    stack.append(node)
                    if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
                        raw = tag
            elif m[1]:
                tag = m[1].lower()
                if tag in (self.tag[k] for k in stack):
                    while self.tag[stack.pop()] != tag:
                        pass
            elif m[0][:2] not in ("<!", "<?"):
                if self.tag[-1] == "#text" and self.parent[-1] == stack[-1]:
                    self.text[-1] += m[0]
                else:
                    self._add("#text", stack[-1], m[0], "")

    def _add(self, tag: str, parent: int, text: str, attributes: str) -> int:
        words = tuple(w for a in _ATTRIBUTE.finditer(attributes) for w in _PARTS.findall((a[2] or a[3] or a[4] or "").lower())) if "=" in attributes else ()
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.words.append(words)
        self.hidden.append(tag in UNSEEN or bool(attributes and _HIDDEN.search(attributes) and _hides(attributes)))
        return len(self.tag) - 1

    def _close(self, stack: list[int], tag: str, within: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if self.tag[stack[k]] in within or self.tag[stack[k]] in CLOSES_P - {"p"}:
                return

    def features(self) -> np.ndarray:
        """A row for each node. Children follow their parents, so sums run backwards."""
        n = len(self.tag)
        parent = np.array(self.parent)
        length, marks = np.zeros(n), np.zeros(n)
        for i, t in enumerate(self.text):
            if t and self.tag[i] == "#text":
                length[i] = len(t.strip())
                marks[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
        nodes, links, runs, paragraphs = np.ones(n), np.zeros(n), (length > 0).astype(float), np.array([float(t == "p") for t in self.tag])
        depth, place, children = np.zeros(n), np.zeros(n), np.zeros(n)
        in_link, hidden = np.zeros(n), np.array(self.hidden)
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            hidden[i] |= hidden[p]
            in_link[i] = in_link[p] or self.tag[i] == "a"
        length[hidden] = 0
        links = length * in_link
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            length[p] += length[i]
            marks[p] += marks[i]
            nodes[p] += nodes[i]
            links[p] += links[i]
            runs[p] += runs[i]
            paragraphs[p] += paragraphs[i]
        self.length, self.unseen = length, hidden
        up = np.maximum(parent, 0)
        density = links / np.maximum(length, 1)
        siblings = children[up]
        numbers = [
            depth, np.log1p(length), density, length / nodes, np.log1p(length / np.maximum(runs, 1)), children, place / np.maximum(siblings - 1, 1), siblings,
            length / max(length[0], 1), length / np.maximum(length[up], 1), marks / np.maximum(length, 1) * 100, paragraphs, in_link,
            (length[up] - length) / np.maximum(siblings - 1, 1), density[up], np.log1p(length[up]), hidden.astype(float),
        ]
        kinds, words = {t: k for k, t in enumerate(TAGS)}, {w: k for k, w in enumerate(WORDS)}
        flags = np.zeros((n, len(TAGS) + len(WORDS)))
        above = np.zeros((n, len(TAGS) + len(WORDS)))
        for i in range(1, n):
            k = kinds.get(self.tag[i])
            if k is not None:
                flags[i, k] = 1
            for w in self.words[i]:
                for part, j in words.items() if w not in words else ((w, words[w]),):
                    if w == part or (len(part) > 3 and part in w):
                        flags[i, len(TAGS) + j] = 1
            above[i] = np.maximum(above[self.parent[i]], flags[self.parent[i]])
        groups = [np.concatenate([np.zeros(len(TAGS)), [float(is_) for is_ in side]]) for side in ([k < BOILERPLATE for k in range(len(WORDS))], [k >= BOILERPLATE for k in range(len(WORDS))])]
        outer = np.array([float(t in OUTER) for t in TAGS] + [0.0] * len(WORDS))
        pooled = [x @ g > 0 for x in (flags, above) for g in (*groups, outer)]
        return np.column_stack([*numbers, *pooled, flags, above])

    def kept(self, odds: np.ndarray) -> np.ndarray:
        """The best consistent choice: log odds of kept nodes less the cost of each parting; a kept node's parent is kept."""
        n = len(self.tag)
        total = odds.astype(float).copy()
        total[self.unseen] = -np.inf
        for i in range(n - 1, 0, -1):
            if total[i] > -PART:
                total[self.parent[i]] += total[i] + PART
        keep = np.zeros(n, dtype=bool)
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and total[i] > -PART
        return keep

    def main_text(self, keep: np.ndarray) -> str:
        """Text of the kept nodes; blocks in page order, white space and block ends as one space."""
        parts: list[str] = []
        for i in range(1, len(self.tag)):
            if self.tag[i] == "#text":
                if keep[i]:
                    parts.append(html.unescape(self.text[i]))
            elif self.tag[i] not in INLINE:
                parts.append("\n")
            # a block also ends where the walk comes back up out of it
            nxt = self.parent[i + 1] if i + 1 < len(self.tag) else 0
            k = i
            while k and k != nxt:
                if self.tag[k] not in INLINE and self.tag[k] != "#text":
                    parts.append("\n")
                k = self.parent[k]
        return _SPACE.sub(" ", "".join(parts)).strip()


# --- boosted trees ---------------------------------------------------------


class Boosted:
    """Gradient-boosted trees for a yes/no target, grown over histograms of quantile bins; each tree sees some of the features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.3, least: float = 4.0, features: int = 64):
        self.rounds, self.depth, self.rate, self.least, self.features = rounds, depth, rate, least, features
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        live = np.flatnonzero(x.min(axis=0) < x.max(axis=0))
        cuts = []
        for k in live:
            values = np.unique(x[:, k])
            cuts.append((values[1:] + values[:-1]) / 2 if len(values) <= 16 else np.unique(np.quantile(x[:, k], np.linspace(0, 1, 17)[1:-1])))
        every = np.stack([np.searchsorted(c, x[:, k], "right") for k, c in zip(live, cuts)], axis=1)
        wide, rng = 17, np.random.default_rng(3)
        mean = np.average(y, weights=weight)
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (p - y), weight * p * (1 - p)
            tree: list[tuple[int, float]] = [(-1, 0.0)] * (2 ** (self.depth + 1))  # feature and cut, or -1 and value
            where = np.ones(len(y), dtype=np.int64)
            some = np.sort(rng.permutation(len(live))[: self.features])
            binned = every[:, some]
            for level in range(self.depth + 1):
                for node in range(2**level, 2 ** (level + 1)):
                    own = np.flatnonzero(where == node)
                    if not len(own):
                        continue
                    sg, sh = g[own].sum(), h[own].sum()
                    tree[node] = (-1, float(-self.rate * sg / (sh + 1.0)))
                    if level == self.depth or len(own) < 4:
                        continue
                    best, split = 1e-3, None
                    flat = binned[own] + np.arange(len(some)) * wide
                    hg = np.bincount(flat.ravel(), np.repeat(g[own], len(some)), len(some) * wide).reshape(-1, wide).cumsum(axis=1)
                    hh = np.bincount(flat.ravel(), np.repeat(h[own], len(some)), len(some) * wide).reshape(-1, wide).cumsum(axis=1)
                    gain = hg**2 / (hh + 1) + (sg - hg) ** 2 / (sh - hh + 1) - sg**2 / (sh + 1)
                    gain[(hh < self.least * 0.05) | (sh - hh < self.least * 0.05)] = 0
                    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[k, b] > best and b < len(cuts[some[k]]):
                        split = (int(live[some[k]]), float(cuts[some[k]][b]))
                    if split:
                        tree[node] = split
                        where[own] = 2 * node + (x[own, split[0]] >= split[1])
            self.trees.append(tree)
            raw += self._tree(tree, x)
        return self

    def _tree(self, tree: list[tuple[int, float]], x: np.ndarray) -> np.ndarray:
        feature, value = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        node, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            k = feature[node]
            inner = k >= 0
            node = np.where(inner, 2 * node + (x[rows, np.maximum(k, 0)] >= value[node]), node)
        return value[node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._tree(t, x) for t in self.trees)


# --- pages to learn from ---------------------------------------------------


def _prose(r: random.Random, least: int, most: int) -> str:
    sounds = "ba ce di fo gu la me ni so tu ra ve zi mo pe ka li sa ter on in est al".split()
    word = lambda: "".join(r.choice(sounds) for _ in range(r.randint(1, 3)))
    out = [word() + r.choice(("", "", "", "", "", ",", ".")) for _ in range(r.randint(least, most))]
    return " ".join(out).capitalize() + r.choice((".", ".", "", "!"))


def sample_page(seed: int) -> str:
    """A page in one of many layouts. Elements whose text is all main text carry `data-main`."""
    r = random.Random(seed)
    p = lambda a, b: _prose(r, a, b)
    pick, chance = r.choice, r.random
    links = lambda n: "".join(f'<li><a href="/{k}">{p(1, 2)}</a></li>' for k in range(r.randint(2, n)))
    named = lambda *names: f' {pick(("class", "id"))}="{pick(names)}"' if chance() < 0.75 else ""

    def clutter() -> str:
        kind = r.randrange(12)
        if kind == 0:
            return f"<nav{named('nav', 'menu', 'main-nav')}><ul>{links(8)}</ul></nav>"
        if kind == 1:
            return f'<div class="{pick(("ad", "ads", "advert", "sponsor", "ad-box", "promo", "advertisement"))}">{pick((p(3, 25), f"<p>{p(4, 30)}</p>", f"<a href=x>{p(3, 9)}</a>"))}</div>'
        if kind == 2:
            return f'<div class="{pick(("sidebar", "side-bar", "widget", "related", "recommended", "right-side"))}"><h3>{p(1, 3)}</h3><ul>{links(9)}</ul>{f"<p>{p(3, 30)}</p>" if chance() < 0.5 else ""}</div>'
        if kind == 3:
            return f"<aside{named('sidebar', 'related', 'widget')}><h2>{p(1, 3)}</h2>{f'<p>{p(5, 40)}</p>' if chance() < 0.7 else f'<ul>{links(6)}</ul>'}</aside>"
        if kind == 4:
            return f'<div {pick(("class", "id"))}="{pick(("cookie-notice", "cookie", "consent", "notice", "alert", "popup", "newsletter", "banner", "gdpr-notice"))}">{pick((p(5, 40), f"<p>{p(5, 40)}</p>"))}<button>{p(1, 2)}</button></div>'
        if kind == 5:
            return f"<form{named('search', 'login', 'subscribe', 'newsletter')}><label>{p(1, 3)}</label><input name=q>{f'<p>{p(2, 15)}</p>' if chance() < 0.4 else ''}<button>{p(1, 2)}</button></form>"
        if kind == 6:
            tag, one = pick((("section", "div"), ("div", "div"), ("div", "p"), ("ul", "li"), ("ol", "li")))
            return f'<{tag} {pick(("class", "id"))}="{pick(("comments", "comment-list", "discussion", "replies", "user-comments", "reader-comments"))}">' + "".join(f"<{one}{named('comment', 'reply', 'comment-body')}>{pick((p(3, 50), f'<p>{p(3, 50)}</p>', f'<b>{p(1, 2)}</b><p>{p(4, 40)}</p>'))}</{one}>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == 7:
            return f'<div class="{pick(("share", "social", "social-links", "breadcrumb", "breadcrumbs", "pagination", "tags"))}">' + " ".join(f"<a href=#>{p(1, 2)}</a>" for _ in range(r.randint(2, 5))) + "</div>"
        if kind == 8:
            return f"<header{named('header', 'site-header', 'masthead')}>{pick((f'<h1>{p(1, 3)}</h1>', f'<a href=/>{p(1, 3)}</a>', f'<div>{p(1, 4)}</div>', f'<p>{p(2, 9)}</p>'))}{f'<ul>{links(5)}</ul>' if chance() < 0.5 else ''}</header>"
        if kind == 9:
            return f"<footer{named('footer', 'site-footer', 'legal')}>&copy; {pick((p(2, 30), f'<p>{p(3, 40)}</p>', f'<a href=/>{p(1, 3)}</a> &middot; {p(2, 20)}'))}</footer>"
        if kind == 10:
            return f"<script>var a='{p(2, 9)}</p>';</script>" + pick(("", "<style>p{margin:0}</style>", f"<!-- {p(2, 6)} -->", f"<noscript>{p(2, 8)}</noscript>"))
        return f'<div class="{pick(("footer", "foot", "copyright", "header", "top-bar", "menu", "nav-bar"))}">{pick((p(2, 25), f"<ul>{links(6)}</ul>", f"<p>{p(2, 25)}</p>"))}</div>'

    def part() -> str:
        kind = r.randrange(20)
        mark = " data-main"
        if kind < 12:
            inner = p(1, 9) if chance() < 0.15 else p(8, 110)
            inner = f"<b>{inner}<br>" if chance() < 0.08 else inner
            inner = inner + f" <a href=/x>{p(1, 4)}</a> " + p(2, 40) if chance() < 0.3 else inner
            return f"<p{mark}>{inner}" + ("</p>" if chance() < 0.85 else "")
        if kind < 14:
            level = pick("234")
            return f"<h{level}{mark}>{p(1, 9)}</h{level}>"
        if kind == 14:
            return f"<ul{mark}>" + "".join(f"<li>{p(3, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind == 15:
            return f"<blockquote{mark}>{pick((p(5, 40), f'<p>{p(5, 40)}</p>'))}</blockquote>"
        if kind == 16:
            return f"<table{mark}>" + "".join(f"<tr><td>{p(1, 4)}</td><td>{p(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind == 17:
            return f"<div{mark}>{p(10, 80)}</div>"
        if kind == 18:
            return f"<pre{mark}>{p(5, 30)}</pre>"
        return clutter() if chance() < 0.6 else f"<p{mark}>{p(20, 90)}</p>"

    heading = lambda: f"<h1 data-main>{p(1, 12)}</h1>" if chance() < 0.85 else ""
    parts = "".join(part() for _ in range(r.randint(1, 14)))
    if chance() < 0.06:
        parts = f"<p data-main>{p(1, 6)}</p>"
    holder = pick(("article", "article", "main", "div", "section", "none", "article"))
    text = heading() + parts
    if holder == "div":
        text = f'<div {pick(("class", "id"))}="{pick(("content", "main", "post", "entry-content", "article-body", "story", "text", "page-content", "post-body"))}">{text}</div>'
    elif holder != "none":
        text = f"<{holder}{named('content', 'post', 'entry', 'main-content') if chance() < 0.4 else ''}>{text}</{holder}>"
    if chance() < 0.4:
        text = f"<div{named('wrap', 'container', 'page', 'row')}>{text}{clutter() if chance() < 0.5 else ''}</div>"
    before, after = "".join(clutter() for _ in range(r.randint(0, 4))), "".join(clutter() for _ in range(r.randint(0, 4)))
    page = f"<!DOCTYPE html><html><head><title>{p(1, 8)}</title></head><body>{before}{text}{after}</body></html>"
    return page[: int(len(page) * (0.6 + 0.4 * chance()))] if chance() < 0.1 else page


def _labels(page: Page, source: str) -> np.ndarray:
    """1 for nodes with main text in or below them, by the marks of `sample_page`."""
    marked = [False]
    for m in _TOKEN.finditer(re.sub(r"(?is)<(script|style|noscript|title)\b.*?</\1>", r"<\1>", source)):
        if m[2] or m[4]:
            marked.append("data-main" in (m[3] or m[5] or ""))
    elements = [i for i, t in enumerate(page.tag) if t != "#text"]
    main = np.zeros(len(page.tag), dtype=bool)
    for i, flag in zip(elements, marked):
        main[i] = flag
    for i in range(1, len(main)):
        main[i] |= main[page.parent[i]]
    label = main & (np.array([t == "#text" for t in page.tag])) & (page.length > 0)
    for i in range(len(label) - 1, 0, -1):
        label[page.parent[i]] |= label[i]
    return label


@lru_cache(maxsize=2)
def train(pages: int = 600, seed: int = 1) -> Boosted:
    xs, ys, ws = [], [], []
    for k in range(pages):
        source = sample_page(seed * 100_000 + k)
        page = Page(source.replace(" data-main", ""))
        x, y = page.features(), _labels(page, source)
        use = (page.length > 0) & ~page.unseen
        use[0] = False
        xs.append(x[use])
        ys.append(y[use])
        ws.append(1 + np.log1p(page.length[use]) / 3)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def texts(model: Boosted, sources: list[str]) -> list[str]:
    """Main text of each page; features of many pages are scored at once."""
    pages = [Page(s) for s in sources]
    tables = [p.features() for p in pages]
    if not tables:
        return []
    odds = model.odds(np.concatenate(tables))
    at, out = 0, []
    for page in pages:
        n = len(page.tag)
        out.append(page.main_text(page.kept(odds[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                found = texts(held.value, [x or "" for x in col(batch, "html").to_pylist()])
                arrays = [col(batch, "page_id"), col(batch, "url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
