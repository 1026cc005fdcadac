"""A small HTML tree on the standard parser, with simple selectors: what page conversion needs, run inside Arrow batches.

Unclosed paragraphs, list items, table cells and the like end where HTML says they do;
a formatting tag left open ends with its block. That is less than a browser's recovery.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of the first kind ends those of the second that are still open next to it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BLOCKS = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Node:
    """An element; ``children`` holds strings and nodes. A node with an empty tag is a document."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str = "", attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)

    def replace(self, *by: Node | str) -> None:
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        self.parent.children[at : at + 1] = by
        for b in by:
            if isinstance(b, Node):
                b.parent = self.parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def html(self) -> str:
        from html import escape

        inner = "".join(c if isinstance(c, str) and self.tag in ("script", "style") else escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children)
        if not self.tag:
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' if v is not None else f" {k}" for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end({"p"}, {"div", "section", "article", "td", "th", "li", "body", "blockquote", "button"})
        if tag in ENDS:
            self.end(ENDS[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def end(self, tags: set[str], stop: set[str]) -> None:
        """Close the open elements up to the outermost of ``tags`` that lies within ``stop``."""
        node, last = self.at, None
        while node.tag and node.tag not in stop:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.tag and node.tag != tag:
            node = node.parent
        if node.tag:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


PART = re.compile(r"""([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w:-]+(?:[*^$~|]?=["']?[^"'\]]*["']?)?\])*)$""")


def simple(part: str):
    """A test for one compound selector: tag, classes, id, attributes."""
    m = PART.match(part)
    if not m or not part:
        raise ValueError(f"selector {part!r}")
    tag, rest = (m[1] or "*").lower(), m[2]
    tests = re.findall(r"""([.#])([\w-]+)|\[([\w:-]+)(?:([*^$~|]?=)["']?([^"'\]]*)["']?)?\]""", rest)

    def ok(n: Node) -> bool:
        if tag not in ("*", n.tag):
            return False
        for mark, name, attr, op, value in tests:
            if mark == "." and name not in n.classes() or mark == "#" and n.attrs.get("id") != name:
                return False
            if attr:
                have = n.attrs.get(attr)
                if have is None:
                    return False
                fits = {"": True, "=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split(), "|=": have == value or have.startswith(value + "-")}
                if not fits[op]:
                    return False
        return True

    return ok


def select(root: Node, selector: str) -> list[Node]:
    """Elements in document order that fit a selector: compounds, descendants, children (``>``), lists by commas."""
    chains = []
    for one in selector.split(","):
        tokens = re.sub(r"\s*>\s*", " > ", one.strip()).split()
        chain, child = [], False
        for t in tokens:
            if t == ">":
                child = True
            else:
                chain.append((simple(t), child))
                child = False
        chains.append(chain)

    def fits(n: Node, chain) -> bool:
        if not chain or not chain[-1][0](n):
            return False
        if len(chain) == 1:
            return True
        up = n.parent
        if chain[-1][1]:
            return up is not None and fits(up, chain[:-1])
        while up is not None and up.tag:
            if fits(up, chain[:-1]):
                return True
            up = up.parent
        return False

    return [n for n in root.walk() if any(fits(n, c) for c in chains)]
