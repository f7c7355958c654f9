"""A tiny element tree on top of the standard library's HTML tokenizer.

Used only to check the JVM expression: same tags, attributes and text.
"""

from __future__ import annotations

import html.entities
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pagequarry.functions.html import OWN_TEXT, PRESERVE, RAW, VOID

_NAMED = {k.rstrip(";"): v for k, v in html.entities.html5.items()}
_BLANK = " \n\t\f\r"


@dataclass
class Element:
    tag: str
    attrs: dict
    parent: "Element | None"
    depth: int
    items: list = field(default_factory=list)  # Element, or (container tag, text)

    def walk(self):
        yield self
        for i in self.items:
            if isinstance(i, Element):
                yield from i.walk()

    def strings(self):
        for i in self.items:
            if isinstance(i, Element):
                yield from i.strings()
            else:
                yield i

    def text(self) -> str:
        own = self.tag if self.tag in RAW + OWN_TEXT else None
        return "".join(t for kind, t in self.strings() if kind == own)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Element("", {}, None, -1)
        self.open = [self.root]
        self.buffer: list[str] = []

    def flush(self):
        data, self.buffer = "".join(self.buffer), []
        if not data:
            return
        tags = [e.tag for e in self.open]
        if not data.strip(_BLANK) and not any(t in PRESERVE for t in tags):
            data = "\n" if "\n" in data else " "
        special = [t for t in tags if t in RAW + OWN_TEXT]
        self.open[-1].items.append((special[-1] if special else None, data))

    def handle_starttag(self, tag, attrs, close_void=True):
        self.flush()
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1], len(self.open) - 1)
        self.open[-1].items.append(e)
        self.open.append(e)
        if close_void and tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, close_void=False)
        self.flush()
        self.open.pop()

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_entityref(self, name):
        self.buffer.append(_NAMED.get(name, "&" + name))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        out = ""
        if code < 256:
            try:
                out = bytes([code]).decode("windows-1252")
            except UnicodeDecodeError:
                out = ""
        if not out:
            try:
                out = chr(code)
            except (ValueError, OverflowError):
                out = ""
        if not out or 0xD800 <= code <= 0xDFFF or code == 0:
            out = "�"
        self.buffer.append(out)

    def silent(self, _):
        self.flush()

    handle_comment = handle_decl = handle_pi = silent

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.open[-1].items.append((None, data[6:]))


def parse_tree(text: str) -> list[dict]:
    t = Tree()
    t.feed(text)
    t.close()
    t.flush()
    return [
        {"tag": e.tag, "depth": e.depth, "attrs": e.attrs, "text": e.text()}
        for e in list(t.root.walk())[1:]
    ]
