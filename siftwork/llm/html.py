"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text between block-level tags. A linear classifier, trained here on made-up pages, gives each block the cost of being
content and the cost of being boilerplate; these are capacities to the two terminals. Neighbours on the page and blocks under one
parent are tied by edges that are stronger the nearer they are in the tree. The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.batches import portions
from siftwork.llm.mincut import source_side

#: Elements whose text is never shown, or is never a part of an article.
UNSEEN = frozenset("script style noscript template head title svg math canvas object iframe textarea select option optgroup datalist button input label fieldset legend audio video map".split())
#: Text inside these runs up to the closing tag, whatever it holds.
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag on the left ends an open element on the right.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()},
}
#: An open element on the right isn't ended from inside these.
SCOPE = ("table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "aside", "blockquote")
NAME = re.compile(r"[a-zA-Z][^\s/><]*")
EDGE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMING = frozenset(("class", "id", "role", "aria-label", "itemprop"))
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Words of class and id by what they say about an element.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc topbar toolbar tabs pager pagination skip",
    "head": "header masthead banner branding logo",
    "foot": "footer foot colophon copyright legal contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended popular trending tags tagcloud",
    "note": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup paywall disclaimer",
    "ad": "ad ads adv advert adverts advertisement adsense promo promotion promoted sponsor sponsored sponsors banner-ad",
    "share": "share sharing social follow login search form",
    "talk": "comment comments reply replies respond discussion disqus responses feedback reviews",
    "main": "article content main post entry story body text articlebody prose",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
TAG_KIND = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "article": "main", "main": "main", "dialog": "note"}
FEATURES = (*(f"near_{k}" for k in KINDS), *(f"far_{k}" for k in KINDS), *(f"tag_{t}" for t in ("h", "li", "cell", "pre")), "plain", "in_article", "linked", "log_words", "few_words", "ends", "stops", "bias")
#: What a tie between two blocks costs to cut, next to each other or under one parent.
ADJACENT, SIBLING = 0.6, 0.5
#: A form that holds one of these frames a part of the page, and so does one with all of the page's text and a heading.
FRAMED = frozenset(("article", "main", "nav", "header", "footer"))
HEADING = re.compile(r"h\d")


@dataclass
class Block:
    text: str
    linked: float
    tag: str
    #: Numbers of the element around it and of that one's parent, among block-level elements.
    element: int
    parent: int
    in_article: bool
    #: How much each kind is said by the nearest element that says any, and by all others around it.
    near: tuple[float, ...] = ()
    far: tuple[float, ...] = ()


@dataclass
class Page:
    """Blocks in page order, and of the block-level elements (0: the page) their parents and depths; an element's number is larger than its parent's."""

    blocks: list[Block]
    up: list[int]
    depth: list[int]

    def apart(self, a: int, b: int, most: int = 64) -> int:
        """Steps between two elements in the tree, if they aren't more than `most`."""
        n = 0
        while a != b and n < most:
            if self.depth[a] >= self.depth[b]:
                a = self.up[a]
            else:
                b = self.up[b]
            n += 1
        return n


def _says(tag: str, rest: str, inside: bool) -> tuple[frozenset[str], bool]:
    """Kinds that a start tag names, and whether it hides the element. The header of an article is a part of it."""
    found = {TAG_KIND[tag]} if tag in TAG_KIND and not (inside and tag == "header") else set()
    hidden = False
    if rest and not rest.isspace():
        for m in ATTRIBUTE.finditer(rest):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in NAMING:
                found.update(KIND_OF[w] for w in map(str.lower, WORDS.findall(value)) if w in KIND_OF)
            hidden = hidden or name == "hidden" or name == "style" and NOT_SHOWN.search(value) is not None
    return frozenset(found), hidden


class Tokens:
    """(kind, name or text, rest) of a page's text and tags in turn; a page is read once, whatever is broken in it.

    kind: text, open, close. A quoted value may hold >. Where a quote that never ends would swallow all that follows, tags from there on end at the next >.
    """

    def __init__(self, page: str):
        self.page, self.at, self.plain, self.gone = page, 0, False, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def end(self, at: int) -> int:
        """Place of the > that closes the tag with attributes from `at`, or -1."""
        first = self.find(">", at)
        if first < 0 or self.plain:
            return first
        while m := EDGE.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = self.find(m[0], m.end()) + 1
            if not at:
                break
        self.plain = True
        return first

    def raw(self, tag: str) -> None:
        """Goes behind the closing tag of `tag`, or to the end."""
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, self.at)
        k = self.find(">", m.end()) if m else -1
        self.at = k + 1 if k >= 0 else len(self.page)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        page = self.page
        while self.at < len(page):
            k = self.find("<", self.at)
            if k != self.at:
                k = k if k >= 0 else len(page)
                text, self.at = page[self.at : k], k
                yield "text", text, ""
                continue
            mark = page[k + 1 : k + 2]
            skip = ("-->" if page.startswith("<!--", k) else "]]>" if page.startswith("<![CDATA[", k) else ">") if mark in ("!", "?") else ""
            if skip:
                j = k + 1 if page.startswith(("<!-->", "<!--->"), k) else k + 4 if skip == "-->" else k
                j = self.find(skip if j != k + 1 else ">", j)
                if j >= 0 or skip != ">":
                    self.at = j + len(skip) if j >= 0 else len(page)
                    if skip == "-->" and page.startswith(("<!-->", "<!--->"), k):
                        self.at = j + 1
                    continue
            m = NAME.match(page, k + 2 if mark == "/" else k + 1)
            if m:
                j = self.find(">", m.end()) if mark == "/" else self.end(m.end())
                if j >= 0:
                    self.at = j + 1
                    yield "close" if mark == "/" else "open", m[0].lower(), page[m.end() : j]
                    continue
            self.at = k + 1
            yield "text", "<", ""


def parsed(page: str | None) -> Page:
    """Blocks with text, in page order; text in elements that are never shown, and in forms, is left out."""
    # Of every element: tag, the block-level element it is or is in, unseen, inside an article, form it is in.
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    places: dict[str, list[int]] = {}  # of the open elements by tag, and of block-level ones
    up, depth, tags, kinds, forms, article, main = [0], [0], [""], [frozenset()], [], [False], [False]
    blocks: list[Block] = []
    block_form: list[int] = []
    parts: list[str] = []
    linked, shown, owner = 0, False, stack[0]

    def close() -> None:
        nonlocal linked, shown
        text = " ".join("".join(parts).split()) if shown else ""
        if text:
            _, e, _, inside, form = owner
            blocks.append(Block(text, min(1.0, linked / max(1, sum(map(len, parts)))), tags[e], e, up[e], inside))
            block_form.append(form)
        parts.clear()
        linked, shown = 0, False

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def drop(i: int) -> None:
        for tag, *_ in stack[i:]:
            places[tag].pop()
            if tag in BLOCK:
                places["*"].pop()
        del stack[i:]

    tokens = Tokens(page or "")
    for kind, name, rest in tokens:
        if kind == "text":
            if not stack[-1][2]:
                # References are those of one text node: what tags part stays apart.
                name = html.unescape(name)
                if not shown and not name.isspace():
                    owner, shown = stack[-1], True
                parts.append(name)
                if places.get("a"):
                    linked += len(name)
            continue
        if name == "br":
            parts.append(" ")
        elif name in BLOCK:
            close()
        if kind == "close":
            i = last(name)
            if i and (name in BLOCK or i > last("*")):
                drop(i)
            continue
        if name in BLOCK and name not in ("html", "head") and last("head"):
            drop(last("head"))
        i = max((last(t) for t in ENDS.get(name, ())), default=0)
        if i and i > max(last(t) for t in SCOPE):
            drop(i)
        if name in VOID:
            continue
        if name in RAW:
            if not (name == "svg" and rest.endswith("/")):
                tokens.raw(name)
            continue
        _, e, unseen, inside, form = stack[-1]
        found, hidden = _says(name, rest, inside)
        inside = inside or name in ("article", "main")
        if name in BLOCK or found:
            up.append(e)
            depth.append(depth[e] + 1)
            tags.append(name if name in BLOCK else tags[e])
            kinds.append(found)
            article.append(name in ("article", "main"))
            main.append(name == "main")
            e = len(up) - 1
            if name == "form":
                form = e
                forms.append(e)
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            places.setdefault("*", []).append(len(stack))
        stack.append((name, e, unseen or hidden or name in UNSEEN, inside, form))
    close()
    words, framed, headed = [0] * len(up), [t in FRAMED for t in tags], [HEADING.fullmatch(t) is not None for t in tags]
    for b in blocks:
        words[b.element] += b.text.count(" ") + 1
    for e in range(len(up) - 1, 0, -1):
        words[up[e]] += words[e]
        article[up[e]], main[up[e]] = article[up[e]] or article[e], main[up[e]] or main[e]
        framed[up[e]], headed[up[e]] = framed[up[e]] or framed[e], headed[up[e]] or headed[e]
    total = max(1, words[0])
    # What a form is beside other text isn't told by how much it has.
    frame = {e for e in forms if framed[e] or words[e] == total and headed[e]}
    near: list[tuple[float, ...]] = [(0.0,) * len(KINDS)]
    far = list(near)
    for e in range(1, len(up)):
        p = up[e]
        if not kinds[e]:
            near.append(near[p])
            far.append(far[p])
            continue
        # What an element says doesn't tell blocks apart if it holds the page, or its main part; but an article may be all there is.
        holds = main[e] and tags[e] != "main" or article[e] and tags[e] != "article" and 2 * words[e] > total
        weight = 0.0 if holds else min(1.0, 2 - 2 * words[e] / total)
        near.append(tuple((1.0 if k == "main" else weight) if k in kinds[e] else 0.0 for k in KINDS))
        far.append(tuple(map(max, far[p], near[p])))
    # A form can't stand in a form: the innermost one decides.
    kept = [b for b, form in zip(blocks, block_form, strict=True) if not form or form in frame]
    for b in kept:
        b.near, b.far = near[b.element], far[b.element]
    return Page(kept, up, depth)


def blocks_of(page: str | None) -> list[Block]:
    return parsed(page).blocks


STOPS = frozenset("the and of to in is that for der die und das ist von den le la les de des et un une el los las que en y del por con".split())


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    place = {f: i for i, f in enumerate(FEATURES)}
    for i, b in enumerate(blocks):
        x[i, : len(KINDS)], x[i, len(KINDS) : 2 * len(KINDS)] = b.near, b.far
        t = b.tag
        name = "h" if re.fullmatch(r"h\d", t) else "cell" if t in ("td", "th", "dd", "dt") else t
        if (at := place.get(f"tag_{name}")) is not None:
            x[i, at] = 1
        n = b.text.count(" ") + 1
        x[i, place["plain"]] = max(0.0, 1 - sum(b.near) - sum(b.far))
        x[i, place["in_article"]] = b.in_article
        x[i, place["linked"]] = b.linked
        x[i, place["log_words"]] = np.log1p(n) / 3
        x[i, place["few_words"]] = n < 5
        x[i, place["ends"]] = b.text[-1] in ".!?:;\"'”»…。"
        x[i, place["stops"]] = min(1.0, 3 * sum(w in STOPS for w in b.text.lower().split()) / n)
        x[i, place["bias"]] = 1
    return x


def _made_up(rng: random.Random) -> list[tuple[str, bool]]:
    """(part of the page, is content) of a page in one of many layouts. Parts that open and close elements have no text."""
    stock = [*STOPS, *("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(80))]

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(stock) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(5, 16).capitalize() + "." for _ in range(rng.randint(a, b)))

    def listed(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def boxed(kind: str, tag: str, body: str) -> str:
        bare = rng.random() < 0.5 and tag != "div"
        name = rng.choice([w for w in KINDS[kind].split() if "-" not in w])
        if rng.random() < 0.3:
            inner = rng.choice(["inner", "box", "text", "content", "body", "row", "entry"])
            body = f"<div class='{inner}'>{body}</div>"
        return f"<{tag}>{body}</{tag}>" if bare else f'<{tag} {rng.choice(["class", "id"])}="{name}">{body}</{tag}>'

    # Pages write their paragraphs in p, or in elements that say nothing.
    para = rng.choices(["<p>{}</p>", "<div>{}</div>", "<section>{}</section>", "<div><div>{}</div></div>", "<div class=c{}>{{}}</div>".format(rng.randint(1, 9)), "<section><p>{}</p></section>"], [10, 3, 2, 2, 2, 1])[0]
    wrap = rng.choice(["article", "main", "div class=content", "div id=main", "div class=post", "section", "div", "div class='entry text'", ""])
    outer = [
        (boxed("menu", rng.choice(["nav", "div", "ul"]), listed(rng.randint(3, 8))), 0.9),
        (boxed("head", rng.choice(["header", "div"]), rng.choice([f"<h1>{words(1, 4)}</h1>", f"<a href=/>{words(1, 2)}</a>", para.format(words(2, 8))])), 0.6),
        (boxed("ad", "div", rng.choice([sentences(1, 2), words(3, 9)])), 0.6),
        (boxed("note", "div", para.format(sentences(1, 2))), 0.5),
        (boxed("side", rng.choice(["aside", "div"]), f"<h3>{words(1, 3)}</h3>" + rng.choice([listed(4), para.format(sentences(1, 2))])), 0.5),
    ]
    tail = [
        (boxed("side", rng.choice(["aside", "div"]), f"<h4>{words(1, 3)}</h4>" + listed(3)), 0.4),
        (boxed("share", "div", listed(3)), 0.4),
        (boxed("talk", rng.choice(["section", "div"]), "".join(rng.choice([para, "<article class=comment><p>{}</p></article>", "<div class='comment-body'><div class=text>{}</div></div>"]).format(sentences(1, 3)) for _ in range(rng.randint(1, 4)))), 0.5),
        (boxed("foot", rng.choice(["footer", "div"]), rng.choice([f"&copy; {words(2, 6)}", para.format(sentences(1, 2)), listed(4)])), 0.9),
    ]
    middle = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.9 else [para.format(sentences(1, 6))]
    for _ in range(rng.randint(1, 9)):
        middle.append(
            rng.choices(
                [para.format(sentences(1, 6)), para.format(f"{words(1, 4)}."), f"<h2>{words(1, 5)}</h2>", f"<ul><li>{words(3, 12)}.</li><li>{words(2, 9)}</li></ul>", f"<blockquote>{sentences(1, 2)}</blockquote>", para.format(f"{words(4, 9)} <a href=/x>{words(1, 3)}</a> {words(2, 9)}."), f"<pre>{words(3, 12)}</pre>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"],
                [8, 2, 2, 1, 1, 3, 1, 1],
            )[0]
        )
    if rng.random() < 0.3:
        # An article's own head.
        middle[0] = rng.choice(["<header>{}</header>", "<div class='entry-header'>{}</div>", "<header class=article-header>{}</header>", "<div class='post-header'>{}</div>"]).format(middle[0]) if wrap else middle[0]
    # Adverts and notices stand inside articles too.
    for box in (boxed("ad", "div", words(3, 9)), boxed("share", "div", listed(3)), boxed("side", "aside", para.format(sentences(1, 1))), boxed("note", "div", sentences(1, 1))):
        if rng.random() < 0.25:
            middle.insert(rng.randint(1, len(middle)), box + "\0")
    open_, shut = (f"<{wrap}>", f"</{wrap.split()[0]}>") if wrap else ("", "")
    before, after = [b for b, p in outer if rng.random() < p], [b for b, p in tail if rng.random() < p]
    if rng.random() < 0.12:
        # A page that is nothing but its text.
        before, after, open_, shut, middle = [], [], "", "", [para.format(rng.choice([words(2, 9), sentences(1, 3)])) for _ in range(rng.randint(1, 3))]
    # The whole page in an element that names its parts.
    frame = rng.choice(["", "", "div class='layout with-sidebar'", "div class='page has-menu has-footer'", "form id=search-page", "div id=wrap", "div class='container comments-open'", "div", "section", "div><div"])
    inside = [*before, open_, *middle, shut, *after]
    content = [False] * (len(before) + 1) + [not m.endswith("\0") for m in middle] + [False] * (len(after) + 1)
    return [(f"<{frame}>" if frame else "", False), *((p.rstrip("\0"), c) for p, c in zip(inside, content, strict=True))]


MADE = re.compile("\x01(\\d+)\x02 ?")
_MODEL: list[np.ndarray] = []


def model(pages: int = 400, seed: int = 7, l2: float = 0.3) -> np.ndarray:
    """Weights of the block classifier: logistic regression on made-up pages with known labels, the same on every call."""
    if not _MODEL:
        rng = random.Random(seed)
        xs, ys = [], []
        for _ in range(pages):
            made = _made_up(rng)
            # Blocks are told by a word of their own that stands before each part's text and is taken out again.
            whole = "".join(re.sub(r">(?=[^<\s])", f">\x01{k}\x02 ", part) if part.count("<") > 1 else part for k, (part, _) in enumerate(made))
            found = parsed(f"<body>{whole}</body>")
            part = [int(m[1]) for b in found.blocks if (m := MADE.search(b.text))]
            for b in found.blocks:
                b.text = MADE.sub("", b.text).strip() or "-"
            xs.append(features(found.blocks))
            ys += [made[k][1] for k in part]
        x, y = np.concatenate(xs), np.array(ys, dtype=float)
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton
            p = 1 / (1 + np.exp(-x @ w))
            h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        _MODEL.append(w)
    return _MODEL[0]


def label(page: Page, weights: np.ndarray) -> list[bool]:
    """True for the blocks of the main text."""
    blocks = page.blocks
    if not blocks:
        return []
    # cost(boilerplate) - cost(content) = log odds; bounded, so that a certain block still listens to certain neighbours
    net = np.clip(features(blocks) @ weights, -8, 8).tolist()
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            far = page.apart(a.element, b.element)
            # Blocks that different kinds of element enclose are hardly tied.
            tie = ADJACENT / (1 + far) if a.near == b.near else ADJACENT / (4 + 4 * far)
            edges.append((i - 1, i, tie))
        j = last.get(b.parent)
        if j is not None and blocks[j].near == b.near:
            edges.append((j, i, SIBLING))
        last[b.parent] = i
    return source_side(net, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = parsed(page)
    return "\n".join(b.text for b, keep in zip(found.blocks, label(found, weights), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of `pages`.

    The whole html is read, in time that grows with its length. Elements with the attribute hidden or an inline display:none are not shown. Forms are
    left out, but for one that frames the page: it holds an article, a menu, a header or a footer, or all of the page's text and a heading. The header of an article belongs to it. A null or empty html, and one without main text, give an empty text; ids and urls may be null or repeated and are
    passed on; other columns are ignored; an empty table gives no rows.
    """
    weights = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
