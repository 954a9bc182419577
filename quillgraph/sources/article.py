"""The main text of a page from its tree: paragraphs vote for the element that holds them.

Elements that never hold an article (scripts, navigation, forms, tables) and those
whose class or id says so (comments, menus, sidebars) go first. Every paragraph of
some length gives its parent points for length and commas, and half as many to the
grandparent; links take points away. The blocks of the best element are the text.
Pages on which nothing scores give all blocks that are left. A page that is broken
is read as far as it goes.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = frozenset("script style noscript template nav header footer aside form table head iframe svg button select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol dl dd dt blockquote pre figure figcaption body html".split())
ASIDE = re.compile(r"\b(comments?|sidebar|side-bar|menu|navigation|nav|breadcrumbs?|footer|share|social|related|promo|advert\w*|ads?|cookie\w*|newsletter|popup|banner)\b", re.I)
#: Shortest paragraph that votes, and the share of link text from which a block is no text.
LEAST, LINKS = 25, 0.5


class Element:
    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.inside, self.points = tag, parent, [], 0.0

    def text(self, links: bool = False) -> str:
        """All text inside; ``links``: that of links alone."""
        return "".join(x if isinstance(x, str) and not links else "" if isinstance(x, str) else x.text(links and x.tag != "a") for x in self.inside)


class Tree(HTMLParser):
    """Elements that may hold text; what is dropped is passed over with all that it holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("html", None)
        self.skipped: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if not self.skipped and tag == "br":
                self.now.inside.append(" ")
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        if self.skipped or tag in DROPPED or (tag not in ("html", "body", "article", "main") and ASIDE.search(named)):
            self.skipped.append(tag)
            return
        if tag == "p" and self.now.tag == "p":  # a paragraph ends where the next begins
            self.now = self.now.parent
        one = Element(tag, self.now)
        self.now.inside.append(one)
        self.now = one

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:  # whatever was left open inside ends with it
                while self.skipped.pop() != tag:
                    pass
            return
        at = self.now
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.now = at.parent

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.now.inside.append(data)


def _plain(text: str) -> str:
    return " ".join(text.split())


def _blocks(e: Element) -> list[tuple[Element, str, float]]:
    """(element, text, share of links) of the innermost blocks, in order; loose text between them counts as one."""
    out, loose = [], []

    def close() -> None:
        text = _plain("".join(x if isinstance(x, str) else x.text() for x in loose))
        if text:
            linked = len(_plain("".join("" if isinstance(x, str) else x.text() if x.tag == "a" else x.text(True) for x in loose)))
            out.append((e, text, linked / len(text)))
        loose.clear()

    todo = [x for x in e.inside]
    for x in todo:
        if not isinstance(x, str) and (x.tag in BLOCKS or any(not isinstance(y, str) and y.tag in BLOCKS for y in x.inside)):
            close()
            out += _blocks(x)
        else:
            loose.append(x)
    close()
    return out


def article(html: str | None) -> str | None:
    """The main text, a line for each block; null for a null page."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    try:
        tree.close()
        blocks = _blocks(tree.root)
    except RecursionError:  # nested without measure: the text as it stands
        return _plain(re.sub(r"(?s)<[^>]*>", " ", html))
    best: Element | None = None
    for e, text, links in blocks:
        if len(text) >= LEAST and links < LINKS:
            points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - links)
            holder = e.parent if e.tag in ("p", "pre", "blockquote", "li") and e.parent else e
            for at, share in ((holder, 1.0), (holder.parent, 0.5)):
                if at is not None:
                    at.points += share * points
                    if best is None or at.points > best.points:
                        best = at

    def held(e: Element | None) -> bool:
        while e is not None and e is not best:
            e = e.parent
        return e is not None

    chosen = [text for e, text, links in blocks if best is None or (held(e) and links < LINKS)]
    return "\n".join(chosen)


@F.arrow_udf(T.StringType())
def article_text(html: pa.Array) -> pa.Array:
    """``article`` for a column, batch by batch."""
    return pa.array([article(x) for x in html.to_pylist()], pa.string())
