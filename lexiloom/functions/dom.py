"""A small tree over html.parser, with what cleaning and parsing of encyclopedia pages need."""

from __future__ import annotations

import weakref
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that an opening tag of the same kind closes, up to the container that ends the search.
NESTING = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": None}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element; children are elements and strings.

    A node holds its children but not its parent, so a tree, and what is removed from one, goes as soon as nothing holds
    it. With cycles it would wait for the collector, and a worker would hold the trees of many pages. Hold the root as
    long as parents are asked for.
    """

    __slots__ = ("name", "attrs", "children", "_parent", "line", "__weakref__")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, line: int = 0):
        self.name, self.attrs, self.parent, self.line = name, attrs, parent, line
        self.children: list[Node | str] = []

    @property
    def parent(self) -> Node | None:
        return self._parent and self._parent()

    @parent.setter
    def parent(self, node: Node | None) -> None:
        self._parent = None if node is None else weakref.ref(node)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def own(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and (not names or c.name in names)]

    def within(self, name: str) -> bool:
        at = self.parent
        while at is not None:
            if at.name == name:
                return True
            at = at.parent
        return False

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack.extend(reversed(x.children))

    def text(self, strip: bool = True) -> str:
        """All strings, each stripped, one after the other."""
        return "".join(s.strip() for s in self.strings()) if strip else "".join(self.strings())

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, parts: list[Node | str]) -> None:
        at = self.parent
        if at is None:
            return
        out: list[Node | str] = []
        for c in at.children:
            if c is self:
                for p in parts:
                    if isinstance(p, Node):
                        p.parent = at
                    out.append(p)
            else:
                out.append(c)
        at.children, self.parent = out, None

    def unwrap(self) -> None:
        self.replace(list(self.children))

    def smooth(self) -> None:
        """Joins strings that follow each other, everywhere below."""
        for node in [self, *self.walk()]:
            out: list[Node | str] = []
            for c in node.children:
                if isinstance(c, str) and out and isinstance(out[-1], str):
                    out[-1] += c
                else:
                    out.append(c)
            node.children = out

    def html(self) -> str:
        parts: list[str] = []
        # What is still to be written, the next one last: nodes, and names of elements to end.
        stack: list[Node | str | tuple[str]] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, tuple):
                parts.append(f"</{c[0]}>")
            elif isinstance(c, str):
                parts.append(c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            else:
                attrs = "".join(f' {k}="{(v or "").replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in c.attrs.items())
                parts.append(f"<{c.name}{attrs}/>" if c.name in VOID else f"<{c.name}{attrs}>")
                if c.name not in VOID:
                    stack.append((c.name,))
                    stack.extend(reversed(c.children))
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in NESTING:
            stop, at = NESTING[tag], self.at
            if stop is None:
                if self.at.name == tag:
                    self.at = self.at.parent
            else:
                same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
                while at.parent is not None and at.name not in stop:
                    if at.name in same:
                        self.at = at.parent
                        break
                    at = at.parent
        if tag in BLOCKS and self.at.name == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v for k, v in attrs}, self.at, self.getpos()[0])
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self.at
        while at.parent is not None:
            if at.name == tag:
                self.at = at.parent
                return
            at = at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page; comments, declarations and end tags of nothing open are dropped, what is left open ends with the page."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
