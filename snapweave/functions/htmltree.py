"""A small HTML tree on the standard parser: enough of implied ends for text, content choice and Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

# Elements without content, and which open elements a start tag ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STOPS = set("table ul ol dl div section article body html select".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self, skip: frozenset[str] = frozenset()):
        """Text pieces in order, with the element that holds each."""
        stack: list = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                yield item
            elif item.tag not in skip:
                stack += [c if isinstance(c, Node) else (c, item) for c in reversed(item.children)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in STOPS - tags:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(ENDS[tag])
        elif tag in BLOCKS:
            self._close({"p"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def find(root: Node, tag: str) -> Node | None:
    return next((n for n in root.walk() if n.tag == tag), None)
