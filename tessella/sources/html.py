"""Blocks of HTML and XHTML pages: paragraphs with roles, emphasis spans, note markers, figures and tables, in order; note bodies."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: elements
BLOCKS = {"p", "div", "li", "blockquote", "td", "th", "figcaption", "section", "article", "body", "dd", "dt", "pre"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SKIP = {"script", "style", "nav", "head", "noscript", "template"}
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "wbr"}
SLANTED, HEAVY = {"em", "i"}, {"b", "strong"}
_SELF_CLOSED = r"(?is)<(title|textarea|style|script|iframe|noembed|noframes|xmp)\b([^>]*?)/>"
_SPACE = re.compile(r"\s+")


def close_raw_elements(c: Column) -> Column:
    """Self-closed raw-text elements become open and close tags, so that they don't swallow the rest."""
    return F.regexp_replace(c, _SELF_CLOSED, "<$1$2></$1>")


def squeeze(text: str) -> tuple[str, list[int]]:
    """White-space runs to single blanks, trimmed, and each raw index's place in the result."""
    out: list[str] = []
    at = []
    for c in text:
        at.append(len(out))
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(c)
    n = len(out) - (1 if out and out[-1] == " " else 0)
    return "".join(out[:n]), [min(x, n) for x in [*at, len(out)]]


class Node:
    """An element: its tag, attributes, children (elements and texts) and parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def inside(self, test) -> bool:
        """Whether this element or one around it passes."""
        node = self
        while node is not None:
            if test(node):
                return True
            node = node.parent
        return False

    def elements(self):
        """All elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.elements()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


#: What an opening tag ends, as far up as the second set goes.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"})}
_NO_PARAGRAPH = BLOCKS | HEADS | {"table", "hr", "ul", "ol", "dl", "figure", "aside"}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags: set[str], upto: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in upto:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _NO_PARAGRAPH:
            self._close({"p"}, {"td", "th", "div", "section", "aside", "figure", "blockquote", "table"})
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    if html:
        b.feed(re.sub(_SELF_CLOSED, r"<\1\2></\1>", html))
        b.close()
    return b.root


# --- fixed values: classes of headings, breaks, notes, captions, headers and boilerplate
_TITLE = re.compile(r"title\d+")
_NOTE_CLASSES = {"footnote", "footnotes", "endnote", "endnotes"}
_NOTEREF = re.compile(r"(?i)\b(noteref|footnote)\b")
_CAPTION = re.compile(r"(?i)(imagefoot|caption|figcaption|leyenda|pie)")
_HEADER = re.compile(r"(?i)(_cab|head|th\b)")
_SPECIAL = {"title", "title1", "epigraph"}


def _marker(a: Node, raised: bool) -> tuple[str, str] | None:
    """(href, label) of an anchor that marks a footnote: to a fragment, raised or typed so, its label of at most 8 characters."""
    href = a.attrs.get("href") or ""
    if "#" not in href or not (raised or any(x.tag == "sup" for x in a.elements()) or "noteref" in (a.attrs.get("epub:type") or "") or _NOTEREF.search(a.attrs.get("class") or "")):
        return None
    label = " ".join(a.text().split())
    return (href, label) if 0 < len(label) <= 8 else None


def rich(node: Node, markers: bool = True, without: Node | None = None, stop=lambda n: False) -> tuple[str, list[dict], list[dict]]:
    """An element's cleaned text, its emphasis spans and note markers in the text's offsets. Markers' labels are no text; ``without``
    and what ``stop`` names are left out."""
    raw: list[str] = []
    spans: list[tuple[int, int, str]] = []
    marks: list[tuple[int, str, str]] = []
    size = 0

    def walk(n: Node, kinds: tuple[str, ...], raised: bool) -> None:
        nonlocal size
        for c in n.children:
            if isinstance(c, str):
                raw.append(c)
                spans.extend((size, size + len(c), k) for k in kinds if c)
                size += len(c)
            elif c is without or c.tag in SKIP or stop(c):
                continue
            elif c.tag == "br":
                raw.append("\n")
                size += 1
            elif markers and c.tag == "a" and (found := _marker(c, raised)):
                marks.append((size, *found))
            else:
                kind = "i" if c.tag in SLANTED else "b" if c.tag in HEAVY else None
                walk(c, (*kinds, kind) if kind and kind not in kinds else kinds, raised or c.tag == "sup")

    walk(node, tuple({"i" if node.tag in SLANTED else "b"} if node.tag in SLANTED | HEAVY else ()), node.tag == "sup")
    text, place = squeeze("".join(raw))
    joined: list[dict] = []
    for s, e, k in sorted((place[s], place[e], k) for s, e, k in spans):
        last = next((x for x in reversed(joined) if x["k"] == k), None)
        if last and s <= last["e"]:
            last["e"] = max(last["e"], e)
        elif s < e:
            joined.append({"s": s, "e": e, "k": k})
    return text, joined, [{"pos": place[p], "id": i, "label": label} for p, i, label in marks]


def _table(node: Node) -> list[list[dict]]:
    """Rows of cells; empty rows go. What lies in a nested table belongs to the outer one."""
    rows = []
    for tr in (x for x in node.elements() if x.tag == "tr" and not _nearest(x, "table", node)):
        cells = []
        for td in (x for x in tr.elements() if x.tag in ("td", "th") and not _nearest(x, "tr", tr)):
            text, spans, marks = rich(td)
            cells.append({"text": text, "spans": spans, "marks": marks, "header": td.tag == "th" or bool(_HEADER.search(td.attrs.get("class") or ""))})
        if any(c["text"] for c in cells):
            rows.append(cells)
    return rows


def _nearest(node: Node, tag: str, top: Node) -> bool:
    """Whether an element of this tag lies between the node and ``top``."""
    node = node.parent
    while node is not None and node is not top:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _caption(img: Node) -> Node | None:
    """A figure's caption: figcaption, a paragraph of a caption's class in the same block, or the one right behind it."""
    block = img.parent
    while block is not None and block.tag not in ("p", "div", "figure"):
        block = block.parent
    if block is None:
        return None
    is_caption = lambda x: x.tag == "p" and _CAPTION.search(x.attrs.get("class") or "")
    if block.tag == "figure" and (found := next((x for x in block.elements() if x.tag == "figcaption"), None)):
        return found
    if found := next((x for x in block.elements() if is_caption(x)), None):
        return found
    around = [c for c in block.parent.children if isinstance(c, Node)] if block.parent else []
    after = around[around.index(block) + 1 :][:1]
    return after[0] if after and is_caption(after[0]) else None


def role_of(node: Node) -> str:
    names = node.classes()
    return "heading" if node.tag in HEADS else "subtitle" if "subtitle" in names else "sceneBreak" if "empty-line" in names else "body"


def blocks(html: str | None, page: Node | None = None) -> list[dict]:
    """The page's blocks in document order: role, text, spans, marks; figures with image and alt, their caption being the text; tables
    with rows; ``boundary`` where a division's class begins a chapter. Boilerplate, footnotes and title pages' divisions are left
    out. Null and empty pages have none; broken markup is read as far as it goes."""
    root = page or tree(html)
    out: list[dict] = []
    used: set[int] = set()

    def add(role, text="", spans=(), marks=(), **more):
        out.append({"role": role, "text": text, "spans": list(spans), "marks": list(marks)} | more)

    def flow(n: Node, pieces: list) -> None:
        """Text that lies in a container by itself is a paragraph of it."""
        if any(isinstance(c, Node) or c.strip() for c in pieces):
            holder = Node(n.tag, n.attrs, n.parent)
            holder.children = list(pieces)
            text, spans, marks = rich(holder)
            if text or marks:
                add(role_of(n), text, spans, marks)
        pieces.clear()

    def walk(n: Node) -> None:
        pieces: list = []
        for c in n.children:
            if isinstance(c, str) or not (c.tag in _NO_PARAGRAPH | {"img", "html", "body", "main", "header", "footer", "center"} | SKIP or _holds_block(c)):
                pieces.append(c)
                continue
            flow(n, pieces)
            if c.tag in SKIP or id(c) in used or "pg-boilerplate" in c.classes() or _NOTE_CLASSES & set(c.classes()):
                continue
            if c.tag == "hr":
                add("sceneBreak")
            elif c.tag == "img":
                _figure(c)
            elif c.tag == "table":
                if rows := _table(c):
                    add("table", rows=rows)
            elif c.tag == "div" and any(_TITLE.fullmatch(x) for x in c.classes()):
                text, spans, marks = rich(c)
                add("heading", text, spans, marks, boundary=True)
            elif c.tag == "div" and _SPECIAL & set(c.classes()):
                continue
            elif c.tag in HEADS | {"p", "li", "pre", "dd", "dt", "figcaption", "blockquote"} and not _holds_block(c):
                images = [x for x in c.elements() if x.tag == "img"]
                text, spans, marks = rich(c)
                role = role_of(c)
                if text or marks or role == "sceneBreak":
                    add(role, text, spans, marks)
                for x in images:
                    _figure(x)
            else:
                walk(c)
        flow(n, pieces)

    def _figure(img: Node) -> None:
        src = (img.attrs.get("src") or "").strip()
        if src and not src.startswith("data:"):
            caption = _caption(img)
            if caption is not None:
                used.add(id(caption))
            text, spans, marks = rich(caption) if caption is not None else ("", [], [])
            add("figure", text, spans, marks, image=unquote(src), alt=(img.attrs.get("alt") or "").strip())

    walk(root)
    return out


def _holds_block(n: Node) -> bool:
    return any(x.tag in _NO_PARAGRAPH for x in n.elements()) or n.tag not in HEADS | {"p"} and any(x.tag == "img" for x in n.elements())


def note_body(page: Node, anchor: str) -> list[dict]:
    """The paragraphs of a note, from the element with this id: the block it is or lies in, a container's paragraphs one by one,
    without the element itself where it is the link back, and without the marks that its label leaves in front."""
    at = next((x for x in page.elements() if x.attrs.get("id") == anchor), None)
    if at is None:
        return []
    hosts = {"p", "li", "td", "dd", "blockquote", "aside", "div", "section"}
    block: Node | None = at
    while block is not None and block.tag not in hosts:
        block = block.parent
    if block is None:
        return []
    paras = [c for c in block.children if isinstance(c, Node) and c.tag == "p"] if block.tag in ("aside", "div", "section") else []
    out = []
    for k, node in enumerate(paras or [block]):
        text, spans, _ = rich(node, markers=False, without=at if at is not block else None)
        if k == 0:
            cut = len(text) - len(text.lstrip(".,:;)]* "))
            text, spans = text[cut:], [{"s": max(0, x["s"] - cut), "e": x["e"] - cut, "k": x["k"]} for x in spans if x["e"] > cut]
        if text.strip():
            out.append({"text": text, "spans": spans})
    return out


SCHEMA = "idx int, role string, text string, spans array<struct<s:int,e:int,k:string>>, marks array<struct<pos:int,id:string,label:string>>"


def page_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """pages: key, html. One row a block."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(k, i, b["role"], b["text"], b["spans"], b["marks"]) for k, h in zip(f[key], f[html]) for i, b in enumerate(blocks(h))]
            yield pd.DataFrame(rows, columns=[key, "idx", "role", "text", "spans", "marks"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {SCHEMA}")
