"""Inner HTML of the elements that a CSS selector matches, for pages with nested elements (a small Arrow helper).

Selectors are compounds of ``tag``, ``.class``, ``#id``, ``[attr]`` and ``[attr=value]`` joined by blanks (descendants),
and lists of them joined by commas. An element that is never closed ends where its parent does.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PART = re.compile(r"([A-Za-z][A-Za-z0-9-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")

Compound = list[tuple[str, str, str | None]]


def parse_selector(selector: str) -> list[list[Compound]]:
    """Alternatives, each a chain of compounds from ancestor to element."""
    out = []
    for one in selector.split(","):
        chain = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one):
            compound, at = [], 0
            while at < len(word):
                m = _PART.match(word, at)
                if not m:
                    raise ValueError(f"unsupported selector {selector!r}")
                tag, cls, ident, attr, value = m.groups()
                compound.append(("tag", tag.lower(), None) if tag else ("class", cls, None) if cls else ("id", ident, None) if ident else ("attr", attr.lower(), value))
                at = m.end()
            chain.append(compound)
        if not chain:
            raise ValueError(f"unsupported selector {selector!r}")
        out.append(chain)
    return out


def _fits(compound: Compound, tag: str, attrs: dict[str, str | None]) -> bool:
    for kind, name, value in compound:
        if kind == "tag" and name not in ("*", tag):
            return False
        if kind == "class" and name not in (attrs.get("class") or "").split():
            return False
        if kind == "id" and attrs.get("id") != name:
            return False
        if kind == "attr" and (name not in attrs or value is not None and attrs[name] != value):
            return False
    return True


class _Finder(HTMLParser):
    def __init__(self, html: str, selector: list[list[Compound]]):
        super().__init__(convert_charrefs=False)
        self.html, self.selector = html, selector
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.stack: list[tuple[str, dict, int, int | None]] = []  # tag, attributes, inner start, place in ``found``
        self.found: list[str] = []
        self.feed(html)
        self.close()
        while self.stack:
            self._end(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _matches(self, tag: str, attrs: dict) -> bool:
        above = [(t, a) for t, a, _, _ in self.stack]
        for chain in self.selector:
            if not _fits(chain[-1], tag, attrs):
                continue
            k = len(above) - 1
            for compound in reversed(chain[:-1]):
                while k >= 0 and not _fits(compound, *above[k]):
                    k -= 1
                if k < 0:
                    break
                k -= 1
            else:
                return True
        return False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        place = None
        if self._matches(tag, attrs):
            place = len(self.found)
            self.found.append("")
        if tag not in _VOID:
            self.stack.append((tag, attrs, self._at() + len(self.get_starttag_text()), place))

    def handle_startendtag(self, tag, attrs):
        if self._matches(tag, dict(attrs)):
            self.found.append("")

    def _end(self, at: int) -> None:
        _, _, start, place = self.stack.pop()
        if place is not None:
            self.found[place] = self.html[start:at]

    def handle_endtag(self, tag):
        if any(t == tag for t, *_ in self.stack):
            at = self._at()
            while self.stack[-1][0] != tag:
                self._end(at)
            self._end(at)


def inner_html(html: str | None, selector: str) -> list[str]:
    """Inner HTML of the matching elements, in document order."""
    return _Finder(html, parse_selector(selector)).found if html else []


def select_inner(html: Column, selector: str) -> Column:
    """array<string> of ``inner_html``."""
    chains = parse_selector(selector)

    @F.arrow_udf("array<string>")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([_Finder(p, chains).found if p else [] for p in pages.to_pylist()], pa.list_(pa.string()))

    return run(html)
