"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of nodes; boosted trees score each by subtree density, attribute tokens, depth
and sibling statistics; the best labelling in which every kept node's ancestors are kept too is found
by one pass up and one down the tree. No labels come with the pages, so the trees learn from a bounded
sample of them: as they are, with their article element as the truth (but for forms, asides, menus,
footers and readers' comments inside it), and laid out anew, their own sentences standing in headings,
paragraphs, lists, tables, quotes and preformatted text, their links and footers in other elements, under
usual names, made-up names or none, truth known.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"?|'[^']*'?|[^\s>"']+)""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Fixed values of HTML: elements without an end, with raw text, that a browser doesn't show, that run
# within a line, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title noscript template iframe noembed noframes svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot body html div section article main aside nav select".split())
NAMED = ("class", "id", "role", "itemprop", "aria-label")
#: Shortens a page's article to about its first paragraph: short articles are rare in a sample.
BRIEF = re.compile(r"(<article\b.*?<p[ >].{0,300}?)<p[ >].*(?=</article>)", re.S | re.I)
NUMBERS, TRUTH = 19, "data-truth"
# Fixed values of HTML: elements that a reader fills in or presses.
CONTROLS = frozenset("input button select textarea label".split())


class Page:
    """Nodes in page order: parent, depth, tokens, truth; and text pieces: node, block, text, in a link.

    Inline elements without naming attributes belong to the node around them. Text that stands beside
    node children gets a node of its own, so that it can be told apart from them.
    """

    __slots__ = ("controls", "depth", "parent", "pieces", "tokens", "truth")

    def __init__(self, source: str):
        self.parent, self.depth, self.tokens, self.truth = [-1], [0], [["t:page"]], [None]
        self.controls: Counter[int] = Counter()  # of a node, those of nodes below not counted
        self.pieces: list[list] = []
        self._read(source)
        self._split()
        self._neighbours()

    def _read(self, source: str) -> None:
        # Open elements: tag, node, links around, hidden.
        open_, at, block, end = [("", 0, 0, False)], 0, 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            _, node, links, hidden = open_[-1]
            if text and not hidden:
                self.pieces.append([node, block, html.unescape(text) if "&" in text else text, links > 0])
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                if m[0].startswith("<![CDATA[") and not hidden:
                    self.pieces.append([node, block, m[0][9:].removesuffix("]]>"), links > 0])
                continue
            name = name.lower()
            if name not in INLINE:
                block += 1
            if m[1]:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] == name:
                        del open_[k:]
                        break
                continue
            if name in CLOSES_P:
                self._close(open_, {"p"}, SCOPES)
            if name in CLOSES:
                self._close(open_, CLOSES[name], SCOPES - {"tbody"})
            _, node, links, hidden = open_[-1]
            if name in CONTROLS and not hidden:
                self.controls[node] += 1
            if name in VOID:
                continue
            named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
            hidden = hidden or name in HIDDEN
            mine = node
            if not hidden and not (name in INLINE and not any(k in named for k in NAMED)):
                words = [w.lower() for k in NAMED if k in named for w in TOKEN.findall(named[k])]
                mine = len(self.parent)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.tokens.append(["t:" + name, *("a:" + w for w in words)])
                truth = named.get(TRUTH)
                self.truth.append(self.truth[node] if truth is None else truth == "1")
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            if name in RAW:
                stop = re.compile(f"</{name}", re.I).search(source, at)
                upto = stop.start() if stop else end
                if not hidden:
                    self.pieces.append([mine, block, source[at:upto], links > 0])
                at = upto
            open_.append((name, mine, links + (name == "a"), hidden))

    @staticmethod
    def _close(open_: list, names: set, until: frozenset) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] in names:
                del open_[k:]
                return
            if open_[k][0] in until:
                return

    def _split(self) -> None:
        inner = set(self.parent)
        own: dict[int, int] = {}
        for piece in self.pieces:
            node = piece[0]
            if node in inner and piece[2].strip():
                if node not in own:
                    own[node] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.tokens.append(["t:#text"])
                    self.truth.append(self.truth[node])
                piece[0] = own[node]

    def _neighbours(self) -> None:
        """Elements before and after a node below its parent, and the tokens of its parent's parent."""
        own, last = [list(t) for t in self.tokens], {}
        for i in range(1, len(own)):
            p = self.parent[i]
            if p in last:
                self.tokens[i].append("before:" + own[last[p]][0])
                self.tokens[last[p]].append("after:" + own[i][0])
            last[p] = i
            if p:
                self.tokens[i] += ["above:" + t for t in own[self.parent[p]]]

    def features(self) -> np.ndarray:
        """A row of NUMBERS per node; the rest of a node's features are its and its parent's tokens."""
        n = len(self.parent)
        chars, linked, marks, words, own = (np.zeros(n) for _ in range(5))
        first = np.full(n, np.inf)
        for k, (node, _, text, link) in enumerate(self.pieces):
            size = len(text.strip())
            if not size:
                continue
            chars[node] += size
            own[node] += size
            linked[node] += size * link
            marks[node] += text.count(".") + text.count(",")
            words[node] += text.count(" ") + 1
            first[node] = min(first[node], k)
        nodes, leaves, paragraphs = np.ones(n), np.zeros(n), np.array([float(t[0] == "t:p") for t in self.tokens])
        controls = np.zeros(n)
        controls[list(self.controls)] = list(self.controls.values())
        parent, children = self.parent, np.zeros(n)
        for i in sorted(range(1, n), key=self.depth.__getitem__, reverse=True):
            p = parent[i]
            children[p] += 1
            for x in (chars, linked, marks, words, nodes, paragraphs, controls):
                x[p] += x[i]
            leaves[p] += leaves[i] or 1
            first[p] = min(first[p], first[i])
        up = np.array(parent)
        up[0] = 0
        place, same, before, after = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        seen, counts, last = np.zeros(n), Counter((parent[i], self.tokens[i][0]) for i in range(n)), {}
        for i in range(1, n):
            p = parent[i]
            place[i] = seen[p]
            seen[p] += 1
            same[i] = counts[p, self.tokens[i][0]]
            if p in last:
                before[i] = chars[last[p]]
                after[last[p]] = chars[i]
            last[p] = i
        total = max(chars[0], 1)
        order = np.where(np.isfinite(first), first, 0) / max(len(self.pieces), 1)
        size = np.maximum(chars, 1)
        out = [np.array(self.depth, float), order, np.log1p(chars), np.log1p(own), linked / size, np.log1p(chars / nodes), marks / size * 100,
               size / np.maximum(words, 1), children, children[up], same, place, np.log1p(before), np.log1p(after), chars / total,
               np.log1p(paragraphs), chars / np.maximum(chars[up], 1), np.log1p(linked[up]), np.log1p(controls)]
        return np.stack(out, 1)

    def text(self, keep: np.ndarray) -> str:
        out, last = [], None
        for node, block, text, _ in self.pieces:
            if keep[node]:
                if last is not None and block != last:
                    out.append(" ")
                out.append(text)
                last = block
        return " ".join("".join(out).split())

    def decoded(self, score: np.ndarray) -> np.ndarray:
        """The labelling of the largest sum of kept nodes' scores in which a kept node's parent is kept."""
        gain, order = score.astype(float).copy(), sorted(range(1, len(self.parent)), key=self.depth.__getitem__, reverse=True)
        for i in order:
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        keep = np.zeros(len(self.parent), bool)
        keep[0] = gain[0] > 0
        for i in reversed(order):
            keep[i] = keep[self.parent[i]] and gain[i] > 0
        return keep


class Trees:
    """Gradient-boosted trees for two classes over byte-sized bins, all of one depth."""

    def __init__(self, tokens: list[str], edges: list[np.ndarray], bias: float):
        self.tokens, self.edges, self.bias = {t: k for k, t in enumerate(tokens)}, edges, bias
        self.splits: list[np.ndarray] = []  # (feature, bin) per inner node, in heap order
        self.values: list[np.ndarray] = []

    def bins(self, pages: list[Page]) -> np.ndarray:
        numbers = np.concatenate([p.features() for p in pages])
        out = np.zeros((len(numbers), NUMBERS + 2 * len(self.tokens)), np.uint8)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.searchsorted(edges, numbers[:, k], "right")
        rows, columns, at = [], [], 0
        for p in pages:
            for i, tokens in enumerate(p.tokens):
                for shift, of in ((0, tokens), (len(self.tokens), p.tokens[p.parent[i]] if i else ())):
                    for t in of:
                        k = self.tokens.get(t)
                        if k is not None:
                            rows.append(at + i)
                            columns.append(NUMBERS + shift + k)
            at += len(p.parent)
        out[rows, columns] = 1
        return out

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(bins), self.bias), np.arange(len(bins))
        for splits, values in zip(self.splits, self.values, strict=True):
            node = np.zeros(len(bins), np.int64)
            for _ in range(len(values).bit_length() - 1):
                feature, at = splits[node, 0], splits[node, 1]
                node = 2 * node + 1 + (bins[rows, feature] > at)
            out += values[node - len(splits)]
        return out

    def grow(self, bins: np.ndarray, ones: tuple, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float, ridge: float = 1.0) -> None:
        """One more tree. ones: (row, column) of the tokens that are there, columns counted from the first
        token; sums over them are sums over few rows, as most tokens are absent from most nodes."""
        node, splits = np.zeros(len(bins), np.int64), np.zeros((2**depth - 1, 2), np.int64)
        splits[:, 1] = 255
        wide, width = 1 + bins[:, :NUMBERS].max(0).astype(np.int64), bins.shape[1] - NUMBERS
        rows, columns = ones
        for level in range(depth):
            base = 2**level - 1
            local, count = node - base, 2**level
            best, each = np.full(count, 1e-6), np.arange(count)
            g_all, h_all = (np.bincount(local, x, count)[:, None] for x in (gradient, hessian))

            def gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
                return g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all * g_all / (h_all + ridge)  # noqa: B023

            def taken(gain: np.ndarray, feature: np.ndarray | int, at: np.ndarray | int, column: np.ndarray) -> None:
                better = np.flatnonzero(gain[each, column] > best)  # noqa: B023
                best[better] = gain[each, column][better]  # noqa: B023
                splits[base + better] = np.stack(np.broadcast_arrays(feature, at + 0 * each), 1)[better]  # noqa: B023

            for f in np.flatnonzero(wide > 1):
                key, cells = local * wide[f] + bins[:, f], count * wide[f]
                g, h = (np.cumsum(np.bincount(key, x, cells).reshape(count, -1), 1)[:, :-1] for x in (gradient, hessian))
                gain = gains(g, h)
                at = gain.argmax(1)
                taken(gain, f, at, at)
            if width:
                key = local[rows] * width + columns
                gain = gains(*(np.bincount(key, x[rows], count * width).reshape(count, -1) for x in (gradient, hessian)))
                at = gain.argmax(1)
                taken(gain, NUMBERS + at, 0, at)
            node = 2 * node + 1 + (bins[np.arange(len(bins)), splits[node, 0]] > splits[node, 1])
        leaf = node - len(splits)
        values = -rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, hessian, 2**depth) + ridge)
        self.splits.append(splits)
        self.values.append(values)


# How pages name their parts, for the layouts that the trees learn from.
CONTENT = ["article", "main", "div id=content", "div class=post-content", "section class=story", "div class=entry-content", "div role=main", "div", "div itemprop=articleBody", "div class=article-body"]
MENU = ["nav", "div class=menu", "ul class=navigation", "div id=nav", "div role=navigation", "div class=breadcrumbs", "nav class=navbar"]
SIDE = ["aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class=widget", "div class=recommended", "section class=related-posts"]
TOP = ["header", "div id=header", "div class=site-header", "div class=masthead", "div role=banner"]
BOTTOM = ["footer", "div id=footer", "div class=site-footer", "div class=copyright", "div role=contentinfo"]
ADVERT = ["div class=ad", "div class=advert", "div class=sponsored", "ins class=adsbygoogle", "div id=ad-banner", "div class=promo", "aside class=advertisement"]
NOTICE = ["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div role=alert", "div class=popup", "div class=gdpr-consent", "div class=newsletter"]
# Elements and names inside an article that hold something else.
NOT_TEXT = frozenset("t:form t:aside t:nav t:footer t:button t:select t:textarea a:comment a:comments a:advert a:ad a:sponsored a:newsletter a:share".split())
COMMENTS = ["section id=comments", "div class=comments", "div id=disqus", "ol class=comment-list", "div class=comment-section", "section class=responses"]


def relaid(page: Page, rng: random.Random, others: list[str]) -> str:
    """A page's own texts in another layout, with the truth in attributes."""
    inside = [p for p in page.pieces if page.truth[p[0]] and p[2].strip()]
    outside = [p[2] for p in page.pieces if not page.truth[p[0]] and p[2].strip()] or ["."]
    paragraphs: dict[int, str] = {}
    for _, block, text, _ in inside:
        paragraphs[block] = paragraphs.get(block, "") + text
    esc = html.escape
    short = lambda: esc(rng.choice(outside)[:80])
    prose = lambda: esc(rng.choice(others))
    some = lambda share, part: [part] if rng.random() < share else []
    named = rng.random() < 0.7  # else all names of this page are made up
    attribute = lambda: rng.choice(["", "", f" class={made_up(rng)}", f' class="{made_up(rng)} {made_up(rng)}"', f" id={made_up(rng)}"])

    def box(kind: str, body: str, truth: str | None = "0") -> str:
        tag, _, name = kind.partition(" ")
        key, _, value = name.partition("=")
        own = (f' {key}="{value}"' if name else "") if named else attribute()
        return f"<{tag}{own}" + (f' {TRUTH}="{truth}"' if truth else "") + f">{body}</{tag}>"

    def links() -> str:
        items = [f'<a href="/{k}">{short()[: rng.randint(4, 30)]}</a>' for k in range(rng.randint(2, 9))]
        return rng.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), " ".join(items), "<p>" + " ".join(items) + "</p>"])

    def remarks() -> str:
        name = rng.choice(["comment", "reply", made_up(rng)])
        each = [rng.choice([f'<div class="{name}"><b>{short()[:14]}</b><p>{prose()[:300]}</p></div>', f"<li><p>{prose()[:200]}</p></li>", f'<div class="{name}">{short()[:20]}: {prose()[:150]}</div>']) for _ in range(rng.randint(1, 5))]
        return rng.choice([f"<h3>{short()[:20]}</h3>", ""]) + "".join(each)

    def fields() -> str:
        return rng.choice([f"<label>{short()}</label>", f"<p>{short()}</p>", short()]) + "<input>" + rng.choice([f"<button>{short()[:12]}</button>", "<input type=submit>"])

    advert = lambda: box(rng.choice(ADVERT), rng.choice([short(), prose()[:120], f"<p>{prose()[:160]}</p>", f"<a href=/x>{prose()[:60]}</a>"]))
    form = lambda: box(rng.choice(["form", "form class=search", "form id=subscribe"]), fields())
    notice = lambda: box(rng.choice(NOTICE), rng.choice([prose()[:200], f"<p>{prose()[:160]}</p><button>{short()[:8]}</button>"]))
    letter = lambda: f"<div{attribute()}>" + rng.choice([f"<p>{prose()[:120]}</p>", prose()[:90], f"<h4>{short()[:24]}</h4><p>{prose()[:90]}</p>"]) + f"<input>{rng.choice(['', '<input type=checkbox>'])}<button>{short()[:12]}</button></div>"
    related = lambda: box(rng.choice(SIDE), rng.choice(["", f"<h3>{short()[:20]}</h3>"]) + links())

    # Some pages put all their paragraphs in one kind of element.
    same = rng.choice(["<p>{}</p>", "<div>{}</div>", "<div>{}</div>", "<section>{}</section>", "{}<br><br>"]) if rng.random() < 0.2 else None

    def stretch(text: str) -> str:
        """Some of the article's own text in some element."""
        if same and rng.random() < 0.9:
            return same.format(esc(text))
        parts = [esc(x) for x in re.split(r"(?<=[.!?]) ", text) if x.strip()]
        whole, kind = esc(text), rng.random()
        if kind < 0.06:  # links that belong to the text: works, sources, parts
            cuts = [x if rng.random() < 0.5 else " ".join(x.split()[: rng.randint(2, 8)]) for x in parts]
            tag, rest = rng.choice(["ul", "ol"]), "" if rng.random() < 0.7 else ", " + prose()[:40]
            return f"<{tag}>" + "".join(f'<li><a href="/{k}">{x}</a>{rest}</li>' for k, x in enumerate(cuts)) + f"</{tag}>"
        if kind < 0.12:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in parts) + f"</{tag}>"
        if kind < 0.16:
            cells = [rng.choice(["td", "td", "th"]) for _ in parts]
            wide = rng.randint(1, 3)
            rows = ["".join(f"<{c}>{x}</{c}>" for c, x in list(zip(cells, parts, strict=True))[k : k + wide]) for k in range(0, len(parts), wide)]
            return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
        if kind < 0.22:
            return rng.choice(["<pre>{}</pre>", "<pre><code>{}</code></pre>"]).format(whole)
        if kind < 0.28:
            return rng.choice(["<blockquote><p>{}</p></blockquote>", "<blockquote>{}</blockquote>"]).format(whole)
        if kind < 0.31:
            return "<dl>" + "".join(f"<{t}>{x}</{t}>" for t, x in zip(["dt", "dd"] * len(parts), parts, strict=False)) + "</dl>"
        if kind < 0.43 and len(parts) > 1 and len(parts[0]) < 140:
            return rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(parts[0]) + "<p>" + " ".join(parts[1:]) + "</p>"
        if kind < 0.48:
            return f"<div{attribute()}>{whole}</div>"
        if kind < 0.52:
            return "<br><br>".join(parts)
        if kind < 0.56:
            return f"<figure><img src=x><figcaption>{parts[0] if parts else whole}</figcaption></figure>" + (f"<p>{' '.join(parts[1:])}</p>" if len(parts) > 1 else "")
        return f"<p{attribute() if rng.random() < 0.2 else ''}>{whole}</p>"

    body = []
    few = rng.randint(1, 2) if rng.random() < 0.2 else len(paragraphs)
    for k, text in enumerate(list(paragraphs.values())[:few]):
        if k == 0 and len(text) < 160 and rng.random() < 0.8:
            title = rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(esc(text))
            body.append(title)
            if rng.random() < 0.25:
                body.append(rng.choice([letter, letter, advert, form, notice])())
        else:
            body.append(stretch(text))
        if rng.random() < 0.08:
            body.append(rng.choice([advert, form, related, lambda: box("div class=share", links()), lambda: box("nav class=toc", links()), notice])())
    body += some(0.12, box(rng.choice(COMMENTS), remarks())) + some(0.12, form()) + some(0.1, box("footer", short()))
    content = box(rng.choice(CONTENT), "".join(body), "1")
    if rng.random() < 0.3:
        content = box(rng.choice(["div class=wrapper", "div id=page", "div class=container", "div", "section"]), content, None)
    before = [
        *some(0.5, notice()),
        *some(0.6, box(rng.choice(TOP), rng.choice([f"<h1>{short()[:30]}</h1>", short()[:40]]) + rng.choice(["", links(), f"<p>{short()}</p>"]))),
        *some(0.8, box(rng.choice(MENU), links())),
        *some(0.5, advert()),
        *some(0.3, form()),
        *some(0.3, box(rng.choice(SIDE), links())),
    ]
    after = [
        *some(0.5, box(rng.choice(SIDE), rng.choice([links(), f"<h3>{short()[:20]}</h3>{links()}", f"<p>{prose()[:250]}</p>"]))),
        *some(0.5, box(rng.choice(COMMENTS), remarks())),
        *some(0.3, form()),
        *some(0.4, advert()),
        *some(0.3, box(rng.choice(NOTICE), f"<p>{prose()[:200]}</p>")),
        *some(0.8, box(rng.choice(BOTTOM), rng.choice([short(), f"<p>{short()}</p>{links()}", "&copy; " + short()]))),
    ]
    parts = "".join(before) + content + "".join(after)
    if rng.random() < 0.12:  # a page laid out in a table
        side = f'<td {TRUTH}="0">{links()}</td>'
        middle = "".join(before[:1]) + f'<td {TRUTH}="1">' + "".join(body) + "</td>"
        parts = "<table><tr>" + rng.choice([side + middle, middle + side, side + middle + side]) + f'</tr></table><table><tr><td {TRUTH}="0">{short()}</td></tr></table>'
    if rng.random() < 0.12:  # a page that holds little or nothing else
        alone = [f'<body {TRUTH}="1">' + "".join(body) + "</body>", f'<body {TRUTH}="0">{content}</body>']
        return f"<html><head><title>{short()}</title></head>{rng.choice([*alone, alone[0]])}</html>"
    return f'<html><head><title>{short()}</title></head><body {TRUTH}="0">{parts}</body></html>'


def made_up(rng: random.Random) -> str:
    """A name that says nothing."""
    return "".join(rng.choice("bcdfghklmnprstvwxz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))


def as_is(source: str) -> Page | None:
    """A page with its article element as the truth, without what isn't text of the article in it; None
    if it has no article."""
    page = Page(source)
    article, left_out = ([False] * len(page.parent) for _ in range(2))
    for i in sorted(range(len(page.parent)), key=page.depth.__getitem__):
        up = page.parent[i]
        article[i] = page.tokens[i][0] == "t:article" or (i > 0 and article[up])
        left_out[i] = article[i] and (bool(NOT_TEXT.intersection(page.tokens[i])) or (i > 0 and left_out[up]))
    page.truth = [a and not o for a, o in zip(article, left_out, strict=True)]
    return page if any(page.truth) else None


def targets(page: Page) -> np.ndarray:
    """A node is to be kept if it lies in the content or holds some."""
    keep = np.array([bool(t) for t in page.truth])
    for i in sorted(range(1, len(keep)), key=page.depth.__getitem__, reverse=True):
        keep[page.parent[i]] |= keep[i]
    return keep


def fit(sources: list[str], layouts: int = 6, trees: int = 110, depth: int = 4, rate: float = 0.3, tokens: int = 200) -> Trees:
    """Trees from a list of pages. Pages without an article teach nothing; without any page that has
    one, the trees learn from layouts of a built-in line, so that every table has a result."""
    rng = random.Random(17)
    known = [p for p in map(as_is, sources) if p] or [as_is("<body><nav><a href=x>Menu</a></nav><article><h1>A title.</h1><p>Some words, and more words.</p></article><footer>End.</footer>")]
    others = [p[2].strip() for page in known for p in page.pieces if page.truth[p[0]] and p[2].strip()]
    brief = [p for p in (as_is(BRIEF.sub(r"\1", s)) for s in sources[::2]) if p]
    pages = known + brief + [Page(relaid(page, rng, others)) for page in known for _ in range(layouts)]
    counts = Counter(t for p in pages for ts in p.tokens for t in set(ts))
    numbers = np.concatenate([p.features() for p in pages])
    edges = [np.unique(np.quantile(numbers[:, k], np.linspace(0, 1, 33)[1:-1])) for k in range(NUMBERS)]
    y = np.concatenate([targets(p) for p in pages])
    weight = np.log1p(np.concatenate([np.maximum(np.expm1(p.features()[:, 2]), 1) for p in pages])) / 4 + 0.5
    share = min(max(y.mean(), 0.01), 0.99)
    model = Trees([t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:tokens]], edges, float(np.log(share / (1 - share))))
    bins = model.bins(pages)
    ones = np.nonzero(bins[:, NUMBERS:])
    margin = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        done = len(model.values)
        model.grow(bins, ones, (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight, depth, rate)
        new = Trees([], [], 0.0)
        new.splits, new.values = model.splits[done:], model.values[done:]
        margin += new.margin(bins)
    return model


def main_texts(sources: list[str], model: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    scores, at, out = model.margin(model.bins(pages)), 0, []
    for page in pages:
        n = len(page.parent)
        out.append(page.text(page.decoded(scores[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, sample: int = 150, longest: int = 30_000) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html): the main text of the whole page.

    Null and empty html give an empty text, as do pages in which nothing is kept. Markup may be broken
    or cut off anywhere. Repeated rows give repeated rows; other columns are ignored; an empty table
    gives an empty result. The trees are fitted on the `sample` pages with the smallest hash among
    those of at most `longest` characters; every page is extracted.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    short = rows.where(F.length("html").between(1, longest)).select("html")
    chosen = smallest(short, F.xxhash64("html"), sample, "html")  # rows of equal pages count one each
    shared = pages.sparkSession.sparkContext.broadcast(fit([r.html for r in chosen.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
