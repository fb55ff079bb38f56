"""HTML pages to sections with their tables and figures, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from granary.functions.rules import SKIPPED_TITLES
from granary.functions.text import preprocess_html
from granary.schemas import FIGURE
from granary.session import Ingest

#: What is removed before sections are read, and image sources that are decoration.
REMOVED_TAGS = frozenset("nav aside footer header iframe object embed video audio canvas svg noscript form script style".split())
REMOVED_CLASSES = frozenset("navigation nav sidebar cookie banner advertisement breadcrumb-nav toc print-only no-print social share comments comment".split())
DECORATION = ("/sprite", "/icon", "/button", "/arrow", "/pixel", "1x1", "transparent.gif", "spacer.gif", "/ui/", "/chrome/", "data:image")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OWN_LINE = frozenset("p div li tr table ul ol h1 h2 h3 h4 h5 h6 section article blockquote pre br td th".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def below(self) -> Iterator[Node | str]:
        """Everything below in page order, by a stack, as pages nest to any depth."""
        waiting = self.children[::-1]
        while waiting:
            c = waiting.pop()
            yield c
            if isinstance(c, Node):
                waiting.extend(reversed(c.children))

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else " " if c.tag in OWN_LINE else "" for c in self.below())

    def all(self, *tags: str) -> Iterator[Node]:
        return (c for c in self.below() if isinstance(c, Node) and c.tag in tags)


class Tree(HTMLParser):
    """A tolerant tree: an unknown end tag is passed over, open inline tags end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") or re.fullmatch("h[1-6]", tag):
            node = self.at
            while node.parent is not None and node.tag in ("p", "b", "i", "a", "span", "em", "strong") + ((tag,) if tag in ("li", "tr", "td", "th") else ()):
                node = node.parent
                self.at = node
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def is_removed(node: Node | str) -> bool:
    return isinstance(node, Node) and (node.tag in REMOVED_TAGS or bool(REMOVED_CLASSES & set(node.attrs.get("class", "").split())) or node.attrs.get("id") == "toc")


def pruned(node: Node) -> Node:
    waiting = [node]
    while waiting:
        one = waiting.pop()
        one.children = [c for c in one.children if not is_removed(c)]
        waiting.extend(c for c in one.children if isinstance(c, Node))
    return node


def squeezed(text: str) -> str:
    return " ".join(text.split())


def table_markdown(table: Node) -> str:
    rows = [[squeezed(c.text()).replace("|", "\\|") for c in tr.all("td", "th")] for tr in table.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def declared_small(img: Node, i: Ingest = Ingest()) -> bool:
    """Both sides declared as whole numbers above nought, and one of them too small."""
    w, h = (int(v) if re.fullmatch("[0-9]{1,9}", v) else 0 for v in (img.attrs.get("width") or "", img.attrs.get("height") or ""))
    return w > 0 and h > 0 and min(w, h) < i.image_least_side


def figure(img: Node, url: str) -> dict | None:
    src = img.attrs.get("src", "")
    if not src or any(d in src.lower() for d in DECORATION) or declared_small(img):
        return None
    node, caption = img.parent, ""
    while node is not None and node.tag != "figure":
        node = node.parent
    if node is not None:
        caption = next((squeezed(c.text()) for c in node.all("figcaption")), "")
    alt = img.attrs.get("alt", "")
    return {"src": src if src.startswith("http") else urljoin(url, src), "alt": alt, "caption": caption or alt or "Figura", "type": "figure" if node is not None else "image"}


def walk(node: Node) -> Iterator[Node | str]:
    """Headings, tables, images and text in page order; what holds a heading is entered."""
    waiting = node.children[::-1]
    while waiting:
        c = waiting.pop()
        if isinstance(c, str) or re.fullmatch("h[1-6]", c.tag) or c.tag in ("table", "img", "title"):
            yield c
            continue
        edge = " " if c.tag in OWN_LINE else ""
        waiting.extend([edge, *reversed(c.children), edge])


def page_sections(html: str, url: str, least: int = 100) -> list[dict]:
    """A section for each heading: what follows it up to the next heading of its level or above."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    items = [x for x in walk(pruned(tree.root)) if not (isinstance(x, Node) and x.tag == "title")]
    heads = [i for i, x in enumerate(items) if isinstance(x, Node) and x.tag[0] == "h" and x.tag != "hr"]
    out = []
    for n, i in enumerate(heads):
        title, level = squeezed(items[i].text()), int(items[i].tag[1])
        if not title:
            continue
        stop = next((j for j in heads[n + 1 :] if int(items[j].tag[1]) <= level), len(items))
        parts, tables, figures = [], [], []
        for x in items[i + 1 : stop]:
            if isinstance(x, str):
                parts.append(x)
            elif x.tag == "table":
                if md := table_markdown(x):
                    tables.append(md)
                    parts.append(f" [Tabella]\n{md} ")
            elif x.tag == "img":
                if (f := figure(x, url)) is not None:
                    figures.append(f)
                    parts.append(f" [Figura: {f['caption']}] ")
            else:
                parts.append(f" {x.text()} ")
        content = squeezed("".join(parts))
        if len(content) >= least and not any(w in title.lower() for w in SKIPPED_TITLES):
            slug = re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", title.lower())).strip("-")
            out.append({"section_id": f"section_{n:03d}", "title": title, "content": content, "level": level, "anchor": slug, "tables": tables, "figures": figures})
    return out


def html_sections(pages: DataFrame, least: int = 100, most_pages: int = 64) -> DataFrame:
    """The sections of pages (page_id, url, html); a page without a heading gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = (batch.iloc[at : at + most_pages] for batch in batches for at in range(0, len(batch), most_pages))
        for some in pages:  # sections of a few pages are held at a time, as sections repeat what lies in sections above them
            rows = [{"page_id": p, "url": u} | s for p, u, h in zip(some["page_id"], some["url"], some["html"], strict=True) for s in page_sections(h or "", u or "", least)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "section_id", "title", "content", "level", "anchor", "tables", "figures"])

    clean = pages.select("page_id", "url", preprocess_html(pages["html"]).alias("html"))
    return clean.mapInPandas(run, f"page_id long, url string, section_id string, title string, content string, level int, anchor string, tables array<string>, figures array<{FIGURE}>")
