"""Main text of web pages: boosted trees over DOM-node features, decoded down the tree so that choices never contradict."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.llm.common import cut

PAGES = 600  # whose markup tells the article, to learn from, at most
ROUNDS, DEPTH = 30, 5
_BEGIN, _LEAVE = 5.0, 4.0  # what it costs to begin the article at a node, and to leave out a part of it
#: Elements that are part of a line, those whose content is never shown as text, and those without content.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = frozenset("head script style noscript template title svg math iframe object canvas audio video map select datalist textarea button".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a new one ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_TAGS = ("article", "main", "section", "div", "p", "heading", "list", "li", "nav", "header", "footer", "aside", "form", "table", "figure", "blockquote", "pre", "body")
_LIKE = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dd": "li", "dt": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "fieldset": "form", "figcaption": "figure"}
#: Beginnings of attribute tokens that go together.
_TOKENS = (
    ("content", "entry", "post", "article", "story", "main", "text", "body"), ("nav", "menu", "breadcrumb", "toolbar", "tabs", "pagination", "pager"), ("footer", "foot", "bottom", "copyright", "colophon", "legal"),
    ("header", "masthead", "topbar", "logo", "brand", "head"), ("sidebar", "side", "aside", "rail", "widget", "complementary"), ("ad", "ads", "advert", "sponsor", "promo", "banner", "partner"),
    ("cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "disclaimer"), ("comment", "reply", "respons", "discuss", "disqus", "thread", "reader", "feedback"),
    ("share", "social", "follow", "like"), ("related", "recommend", "more", "teaser", "popular", "trending", "links"), ("form", "login", "search", "subscribe", "newsletter", "signup", "contact"), ("meta", "byline", "author", "date", "tag", "categor"),
)
_EXACT = frozenset({"ad", "ads", "side", "head", "foot", "like", "more", "tag", "text", "body", "main", "post", "nav", "date", "form", "links"})
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_TO_QUOTE = re.compile(r"[>\"']")
#: Elements that may stand in a head, and those that end a picture drawn in markup.
_IN_HEAD = frozenset({"base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template", "head"})
_BREAKS_OUT = frozenset({"blockquote", "body", "center", "dd", "div", "dl", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "menu", "ol", "p", "pre", "ruby", "table", "ul"})
_CELLS, _TABLE_PARTS = ("td", "th", "table"), frozenset({"table", "tr", "tbody", "thead", "tfoot", "body", "html"})
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_NOT_CAPITAL = bytes(i for i in range(256) if not chr(i).isupper())
_NOT_DIGIT = bytes(i for i in range(256) if not 48 <= i < 58)
_FIELDS = 24 + len(_TAGS) + 2 * len(_TOKENS) + 6


def _group(token: str) -> Iterator[int]:
    for g, stems in enumerate(_TOKENS):
        if any(token == s or s not in _EXACT and token.startswith(s) for s in stems):
            yield g


_KNOWN: dict[str, tuple[int, ...]] = {}


def token_groups(attributes: str) -> set[int]:
    out: set[int] = set()
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if value in _KNOWN:
            out.update(_KNOWN[value])
            continue
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
        found = tuple(sorted({g for token in _SPLIT.split(spaced) if token for g in _group(token)}))
        if len(_KNOWN) > 20_000:
            _KNOWN.clear()
        if len(value) <= 400:
            _KNOWN[value] = found
        out.update(found)
    return out


class Marks:
    """The marks of a page in order. Nothing is searched for twice in vain: what stands nowhere behind one place stands nowhere behind a later one."""

    def __init__(self, source: str) -> None:
        self.source, self.missing, self.quotes = source, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        place = self.source.find(what, at)
        if place < 0:
            self.missing.add(what)
        return place

    def tag_end(self, at: int) -> int:
        """Behind the `>` that ends a tag, quoted ones left out; once a quote is found that nothing closes, tags end at their first `>`."""
        first = self.find(">", at)
        if first < 0:
            return -1
        while self.quotes:
            m = _TO_QUOTE.search(self.source, at)
            if m and m[0] == ">":
                return m.end()
            at = self.find(m[0], m.end()) + 1 if m else 0
            self.quotes = at > 0
        return first + 1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(start, end, kind, name, attributes) of the next mark from a place on; kind: open, close, data or other; end: no mark is left."""
        source = self.source
        while (start := self.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, "other", "", ""
            if source.startswith("<![CDATA[", start) and (end := self.find("]]>", start + 9)) >= 0:
                return start, end + 3, "data", "", ""
            m = _NAME.match(source, start)
            if (m or source[start + 1 : start + 2] in ("!", "?")) and (end := self.tag_end(m.end()) if m else self.find(">", start) + 1) > 0:
                if not m:
                    return start, end, "other", "", ""
                return start, end, "close" if source[start + 1] == "/" else "open", m[1].lower(), source[m.end() : end - 1]
            at = start + 1
        return len(source), len(source), "end", "", ""

    def raw_end(self, name: str, at: int) -> int:
        """Behind the closing tag of an element whose content is no markup; the end of the page if there is none."""
        if f"</{name}" in self.missing:
            return len(self.source)
        m = re.compile(rf"</{name}\s*>", re.I).search(self.source, at)
        if m is None:
            self.missing.add(f"</{name}")
        return m.end() if m else len(self.source)


class Open:
    """The open elements of a page, each kind found without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = [(0, "root")]
        self.places: dict[str, list[int]] = {"root": [0]}

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((node, name))

    def pop(self) -> None:
        _, name = self.stack.pop()
        self.places[name].pop()

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names, -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, name: str) -> bool:
        """End the innermost element of a name and what is open in it; cells and tables hold back others."""
        own = self.last((name,))
        if own < 1 or name not in _TABLE_PARTS and self.last(_CELLS) > own:
            return False
        while len(self.stack) > own:
            self.pop()
        return True


class Page:
    """The elements of a page that are not inline, with what their own lines and everything below them hold."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth, self.groups, self.kept = ["root"], [-1], [0], [set()], [None]
        self.pieces: list[tuple[int, str]] = []  # text in page order, each with the element it stands in
        self.linked: list[bool] = []
        self.marks = [0]  # inline elements and controls of an element
        marks, opened = Marks(source), Open()
        stack = opened.stack
        links, at = 0, 0
        hidden, inner = "", {}  # a hidden element, and how many of each name are open in it
        while True:
            start, end, kind, name, attributes = marks.next(at)
            if start > at:
                if hidden == "head" and not source[at:start].isspace():  # text cannot stand in a head
                    hidden = ""
                if not hidden:
                    self._text(stack[-1][0], source[at:start], links)
            at = end
            if kind == "end":
                break
            if kind == "data" and not hidden:
                self._text(stack[-1][0], source[start + 9 : end - 3], links)
            if kind in ("data", "other"):
                continue
            if hidden and kind == "open":
                if hidden == "head" and name not in _IN_HEAD or hidden in ("svg", "math") and name in _BREAKS_OUT:
                    hidden = ""
                else:
                    if name in _RAW and not attributes.endswith("/"):
                        at = marks.raw_end(name, at)
                    elif name not in _VOID and not attributes.endswith("/"):
                        inner[name] = inner.get(name, 0) + 1
                    continue
            elif hidden:
                if inner.get(name):
                    inner[name] -= 1
                    continue
                if name == hidden:
                    hidden = ""
                    continue
                if name in _INLINE or not opened.places.get(name):
                    continue
                hidden = ""  # it ends with what it stands in
            if kind == "close":
                if name == "a":
                    links = max(0, links - 1)
                elif name == "br":
                    self._text(stack[-1][0], " ", 0)
                if name not in _INLINE and opened.close(name):
                    links = 0
                continue
            closed = attributes.endswith("/")
            if name in _RAW or name in _HIDDEN:
                if not closed:
                    if name in _RAW:
                        at = marks.raw_end(name, at)
                    else:
                        hidden, inner = name, {}
                self.marks[stack[-1][0]] += name in ("select", "textarea", "button")
                continue
            if name in _INLINE or name in _VOID:
                self.marks[stack[-1][0]] += 1
                links += name == "a"
                if name == "br":
                    self._text(stack[-1][0], " ", 0)
                continue
            links = 0
            if name in ("html", "body") and opened.places.get(name):
                continue
            if stack[-1][1] == "p":
                opened.pop()
            ends, holds = _ENDS.get(name), _HOLDS.get(name, ())
            while ends and opened.last(ends) > opened.last(holds):
                opened.pop()
            if stack[-1][1][0] == "h" and stack[-1][1] in _LIKE and name in _LIKE and _LIKE[name] == "heading":
                opened.pop()
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1][0])
            self.depth.append(self.depth[stack[-1][0]] + 1)
            self.groups.append(token_groups(attributes) if attributes else set())
            kept = re.search(r"data-kept=\"?(\d)", attributes) if attributes else None
            self.kept.append(int(kept[1]) if kept else None)
            self.marks.append(0)
            opened.push(node, name)

    def _text(self, node: int, raw: str, links: int) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append((node, text))
        self.linked.append(links > 0)

    def features(self) -> np.ndarray:
        """One row for each element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.zeros((n, 7))  # characters, linked characters, words, ends of sentences, commas, capitals, digits
        first = np.full(n, 1e18)
        total = 0
        for (node, text), linked in zip(self.pieces, self.linked, strict=True):
            size = len(text) if not text.isspace() else 0
            if size:
                row = own[node]
                row[0] += size
                row[1] += size * linked
                row[2] += text.count(" ") + 1
                row[3] += text.count(". ") + text.count("! ") + text.count("? ") + (text.rstrip()[-1] in ".!?")
                row[4] += text.count(",")
                plain = text.encode("latin-1", "ignore")
                row[5] += len(plain.translate(None, _NOT_CAPITAL))
                row[6] += len(plain.translate(None, _NOT_DIGIT))
                first[node] = min(first[node], total)
                total += size
        marks = np.array(self.marks, float)
        is_p = np.array([t == "p" for t in self.tag], float)
        below, below_marks, tags, ps = own.copy(), marks.copy(), np.ones(n), is_p.copy()
        children, order = np.zeros(n), np.zeros(n)
        same: dict[tuple[int, str], int] = {}
        last: dict[int, int] = {}
        before = np.full(n, -1)
        for i in range(1, n):
            p = self.parent[i]
            order[i] = children[p]
            children[p] += 1
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
            before[i] = last.get(p, -1)
            last[p] = i
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            below[p] += below[i]
            below_marks[p] += below_marks[i]
            tags[p] += tags[i]
            ps[p] += ps[i]
            first[p] = min(first[p], first[i])
        after = np.full(n, -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        size = below[:, 0]
        safe = np.maximum(size, 1)
        links = below[:, 1] / safe
        side = lambda at: np.stack([np.where(at >= 0, np.log1p(size[at]), -1), np.where(at >= 0, links[at], -1)], axis=1)
        up = np.maximum(parent, 0)
        whole = max(1.0, size[0])
        alike = np.array([same.get((p, t), 0) for p, t in zip(self.parent, self.tag, strict=True)], float)
        columns = [
            np.log1p(size), np.log1p(own[:, 0]), links, np.log1p(size / tags), size / whole, size / np.maximum(size[up], 1), below[:, 3] / np.maximum(1, below[:, 2]) * 10, below[:, 4] / np.maximum(1, below[:, 2]) * 10,
            below[:, 5] / safe, below[:, 6] / safe, np.log1p(below[:, 2] / np.maximum(1, tags)), np.array(self.depth, float), children, np.log1p(tags), ps / tags, ps, below_marks / tags, alike,
            order / np.maximum(1, children[up]), np.minimum(first, total) / max(1, total), own[:, 0] / safe, own[:, 1] / np.maximum(1, own[:, 0]), np.log1p(below[:, 2] / np.maximum(1, below[:, 3])), np.log1p(size[up]),
        ]
        out = np.zeros((n, _FIELDS), np.float32)
        out[:, :24] = np.stack(columns, axis=1)
        at = 24
        for i, t in enumerate(self.tag):
            t = _LIKE.get(t, t)
            if t in _TAGS:
                out[i, at + _TAGS.index(t)] = 1
        at += len(_TAGS)
        for i in range(n):
            for g in self.groups[i]:
                out[i, at + g] = 1
            if i:  # the tokens of everything above
                out[i, at + len(_TOKENS) : at + 2 * len(_TOKENS)] = np.maximum(out[self.parent[i], at : at + len(_TOKENS)], out[self.parent[i], at + len(_TOKENS) : at + 2 * len(_TOKENS)])
        at += 2 * len(_TOKENS)
        out[:, at : at + 2], out[:, at + 2 : at + 4] = side(before), side(after)
        boiler = np.array([t in ("nav", "aside", "footer", "form", "header", "menu") for t in self.tag], float)
        main = np.array([t in ("article", "main") for t in self.tag], float)
        for i in range(1, n):
            boiler[i], main[i] = max(boiler[i], boiler[self.parent[i]]), max(main[i], main[self.parent[i]])
        out[:, at + 4], out[:, at + 5] = boiler, main
        return out

    def decode(self, odds: np.ndarray, begin: float = _BEGIN) -> np.ndarray:
        """Which elements belong to the article. Every element is outside it, in it, or cut out of it; below one outside may be ones in it,
        below one in it ones cut out, below one cut out nothing else. The best such labelling by the log odds, weighted by each
        element's own text, is found from the leaves up; switching costs a little. If no article pays for its beginning, as in a
        very short one, that cost is waived."""
        n = len(self.tag)
        own = np.zeros(n)
        for node, text in self.pieces:
            own[node] += len(text.strip())
        gain = odds * (0.2 + np.log1p(own))
        best = np.zeros((n, 3))  # outside, in, cut out
        best[:, 1] = gain
        step = np.zeros((n, 2), bool)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            out, into, off = best[i]
            step[i] = into - begin > out, off - _LEAVE > into
            best[p, 0] += max(out, into - begin)
            best[p, 1] += max(into, off - _LEAVE)
            best[p, 2] += off
        state = np.zeros(n, int)
        state[0] = 1 if best[0, 1] - begin > best[0, 0] else 0
        for i in range(1, n):
            s = state[self.parent[i]]
            state[i] = 2 if s == 2 else s + int(step[i, s])
        if begin and not (state == 1).any():
            return self.decode(odds, 0.0)
        return state == 1

    def text(self, keep: np.ndarray) -> str:
        """The kept elements' lines in page order: a block is text that no other element interrupts."""
        blocks: list[str] = []
        now, open_at = [], -1
        for node, text in [*self.pieces, (-1, "")]:
            if node != open_at:
                if open_at >= 0 and keep[open_at] and (line := " ".join("".join(now).split())):
                    blocks.append(line)
                now, open_at = [], node
            now.append(text)
        return "\n".join(blocks)


def truth(page: Page) -> np.ndarray | None:
    """Which elements belong to the article by the page's own markup; None where it does not tell."""
    if not any(t in ("article", "main") for t in page.tag) and 1 not in page.kept:
        return None
    out = np.zeros(len(page.tag), bool)
    for i in range(1, len(page.tag)):
        t, kept = page.tag[i], page.kept[i]
        inside = out[page.parent[i]] or t in ("article", "main")
        out[i] = bool(kept) if kept is not None else inside and t not in ("nav", "aside", "footer", "form", "menu") and not page.groups[i] & {1, 4, 5, 6, 7, 8, 10}
    return out


def variants(source: str, others: list[str], rng: np.random.Generator) -> Iterator[str]:
    """The page itself and pages with the same article in other surroundings: other elements and attribute tokens, and side matter with
    texts of other pages in and around the article. data-kept tells what belongs to it."""
    yield from (source,) * 3  # what the corpus looks like counts most
    word = lambda g: str(rng.choice(_TOKENS[g]))
    for _ in range(4):
        out = source
        keep = float(rng.choice([1.0, 0.5, 0.15]))
        shape = float(rng.choice([0.0, 0.3]))
        out = re.sub(r"<p>([^<]*)</p>", lambda m: _reshaped(m[1], keep, shape, rng), out)  # noqa: B023
        box = str(rng.choice(["div", "div", "div", "div", "section", "main", "article"]))
        label = f' class="{word(0)}-{rng.integers(9)}"' if rng.random() < 0.6 else ""
        out = re.sub(r"<article\b[^>]*>", f'<{box}{label} data-kept="1">', out)
        out = out.replace("</article>", f"{{inside}}</{box}>")
        if rng.random() < 0.7:
            out = re.sub(r"<nav\b[^>]*>", f'<div class="{word(1)}">', out).replace("</nav>", "</div>")
        if rng.random() < 0.7:
            out = re.sub(r"<footer\b[^>]*>", f'<div id="{word(2)}">', out).replace("</footer>", "</div>")
        if rng.random() < 0.5:
            out = re.sub(r'<div class="ad">', f'<div class="{word(5)}">', out)
        extra = [_side(int(g), word, others, rng) for g in rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 10], size=rng.integers(1, 5))]
        inner = _side(int(rng.choice([5, 7, 8, 9, 10])), word, others, rng) if rng.random() < 0.5 else ""
        out = out.replace("{inside}", inner)
        for piece in extra:
            if rng.random() < 0.5 and "<body>" in out:
                out = out.replace("<body>", "<body>" + piece, 1)
            else:
                out = out.replace("</body>", "") + piece
        for _ in range(int(rng.integers(0, 3))):
            out = out.replace("<body>", f'<body><div class="{rng.choice(["wrap", "page", "container", "row", "site"])}">', 1)
        yield out


def _reshaped(text: str, keep: float, shape: float, rng: np.random.Generator) -> str:
    """A paragraph of the article as it is, left out, shortened, or as a list, a quotation or a heading."""
    if rng.random() > keep:
        return ""
    if keep < 1 and rng.random() < 0.5:
        text = text[: int(rng.integers(15, 250))]
    if rng.random() >= shape:
        return f"<p>{text}</p>"
    kind = rng.integers(4)
    if kind == 0:
        parts = re.findall(r".{1,60}(?:\s|$)", text) or [text]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in parts[:8]) + "</ul>"
    return (f"<blockquote><p>{text}</p></blockquote>", f"<h2>{text[:50]}</h2>", f"<div>{text}</div>")[kind - 1]


def _side(group: int, word, others: list[str], rng: np.random.Generator) -> str:
    text = lambda: str(others[rng.integers(len(others))])[: int(rng.integers(20, 400))].replace("<", " ").replace("&", " ")
    tag = {1: "nav", 3: "header", 4: "aside", 10: "form"}.get(group, "div") if rng.random() < 0.4 else str(rng.choice(["div", "section"]))
    mark = f' {rng.choice(["class", "id"])}="{word(group)}"' if rng.random() < 0.95 or tag in ("div", "section") else ""
    if group in (1, 8, 9):
        body = "<ul>" + "".join(f'<li><a href="/x">{text()[:40]}</a></li>' for _ in range(rng.integers(2, 9))) + "</ul>"
    elif group == 7:
        body = "<h3>" + text()[:20] + "</h3>" + "".join(f'<div class="{word(7)}-item"><p>{text()}</p></div>' for _ in range(rng.integers(1, 5)))
    elif group == 10:
        body = f'<label>{text()[:20]}</label><input type="text"><p>{text()[:60]}</p><button>Ok</button>'
    else:
        body = "".join(f"<p>{text()}</p>" for _ in range(rng.integers(1, 4)))
    if rng.random() < 0.5:
        level = 1 if group == 3 else int(rng.integers(2, 5))
        body = f"<h{level}>{text()[:25]}</h{level}>" + body
    return f'<{tag}{mark} data-kept="0">{body}</{tag}>'


@dataclass
class Trees:
    """Boosted trees as flat arrays: at a leaf, left is the leaf itself."""

    field: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds that each row belongs to the article."""
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH + 1):
                node = np.where(x[rows, self.field[node]] <= self.at[node], self.left[node], self.right[node])
            out += self.value[node]
        return np.clip(2 * out, -6, 6)


def read_trees(described: str) -> Trees:
    """The trees of a fitted model from its description: `If (feature i <= t)`, `Else`, `Predict: v`."""
    field, at, left, right, value, roots = [], [], [], [], [], []

    def add(f: int, t: float, v: float) -> int:
        for to, x in ((field, f), (at, t), (left, len(field)), (right, len(field)), (value, v)):
            to.append(x)
        return len(field) - 1

    lines = [x.strip() for x in described.split("\n")[1:] if x.strip()]
    weight, i = 1.0, 0

    def node() -> int:
        nonlocal i
        line = lines[i]
        i += 1
        if line.startswith("Predict:"):
            return add(0, 0.0, weight * float(line.split(":")[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        own = add(int(m[1]), float(m[2]), 0.0)
        left[own] = node()
        i += 1  # Else
        right[own] = node()
        return own

    while i < len(lines):
        m = re.match(r"Tree \d+ \(weight (\S+)\)", lines[i])
        weight = float(m[1])
        i += 1
        roots.append(node())
    return Trees(np.array(field), np.array(at), np.array(left), np.array(right), np.array(value), roots)


def fit(pages: DataFrame, html: str = "html", limit: int = PAGES, seed: int = 17) -> Trees | None:
    """Boosted trees from at most `limit` different pages (those whose hash is smallest) whose own markup tells the article, each also in
    other surroundings, so that the trees do not lean on that markup. None if there are no such pages."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    told = pages.select(F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    hashes = told.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(limit)
    told = told.join(F.broadcast(hashes), F.xxhash64("html") == F.col("h"), "left_semi")
    chosen = cut(told.groupBy(F.xxhash64("html").alias("h")).agg(F.min("html").alias("html")).select("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(0).to_pylist()
            others = [x for s in sources for x in re.findall(r"<p[^>]*>([^<]{30,})", s)] or ["text"]
            rng = np.random.default_rng(seed)
            x, y = [], []
            for source in sources:
                for variant in variants(source, others, rng):
                    page = Page(variant)
                    label = truth(page)
                    if label is not None:
                        x.append(page.features())
                        y.append(label)
            flat = np.concatenate(x) if x else np.zeros((0, _FIELDS), np.float32)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel().astype(np.float64)), _FIELDS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate(y).astype(np.float64) if y else np.zeros(0))], names=["x", "y"])

    rows = cut(chosen.repartition(8, "html").mapInArrow(run, "x array<double>, y double"))
    kinds = {r.y for r in rows.select("y").distinct().collect()}
    if len(kinds) < 2:
        return None
    rows = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(rows)
    return read_trees(model.toDebugString)


def plain_odds(page: Page) -> np.ndarray:
    """Without trees: what stands in an article, or else outside menus and the like, as markup and tokens say."""
    label = truth(page)
    if label is None:
        label = np.ones(len(page.tag), bool)
        for i in range(1, len(page.tag)):
            label[i] = label[page.parent[i]] and page.tag[i] not in ("nav", "aside", "footer", "form", "header", "menu") and not page.groups[i] & set(range(1, 12))
    return np.where(label, 2.0, -2.0)


def extract_one(source: str, trees: Trees | None) -> str:
    return next(extract_some([source], trees))


def extract_some(sources: list[str], trees: Trees | None) -> Iterator[str]:
    """The main text of each page; the trees judge the elements of all pages at once."""
    pages = [Page(source) for source in sources]
    if trees is None:
        odds = [plain_odds(page) for page in pages]
    elif pages:
        odds = np.split(trees.odds(np.concatenate([page.features() for page in pages])), np.cumsum([len(page.tag) for page in pages])[:-1])
    else:
        odds = []
    for page, own in zip(pages, odds, strict=True):
        yield page.text(page.decode(own))


def _few(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of at most 64 pages or little over a million characters."""
    some, size = [], 0
    for value in texts:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if len(some) == 64 or size > 1 << 20:
            yield some
            some, size = [], 0
    yield some


def extract(pages: DataFrame, trees: Trees | None, keep: Iterable[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep, text (the main text, empty if there is none) and n_chars (its code points) of each page, by its whole html.

    Null and empty pages have an empty text; unclosed and wrongly nested elements end as browsers end them, broken markup counts as
    text; rows with nulls in keep and repeated rows stay; an empty table gives an empty one; other columns are left out."""
    keep = list(keep)
    rows = pages.select(*keep, pages[html].alias("__html"))
    schema = T.StructType([*(pages.schema[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [text for some in _few(batch.column(len(keep))) for text in extract_some(some, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
