"""Html as a run of tags and the text between them, for edits that leave everything else as it was written."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z][^\s<>/"']*)(?P<rest>(?:[^<>"']+|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""\s+(?P<name>[^\s=<>/"']+)(?:\s*=\s*(?:"(?P<two>[^"]*)"|'(?P<one>[^']*)'|(?P<bare>[^\s"'<>]+)))?""")


class Attribute:
    """One attribute as it stands in a tag, white space before it included; value is None where it has none."""

    __slots__ = ("name", "quoted", "raw", "value")

    def __init__(self, found: re.Match):
        self.raw, self.name = found[0], found["name"].lower()
        self.quoted = found["bare"] is None
        self.value = next((v for v in (found["two"], found["one"], found["bare"]) if v is not None), None)


class Tag:
    __slots__ = ("ends", "name", "raw")

    def __init__(self, found: re.Match):
        self.raw, self.name, self.ends = found[0], found["name"].lower(), bool(found["end"])

    @property
    def closed(self) -> bool:
        return self.raw.endswith("/>")

    def attributes(self) -> Iterator[Attribute]:
        return map(Attribute, _ATTRIBUTE.finditer(self.raw, len(self.name) + 1))

    def get(self, name: str) -> str | None:
        """Value of the first attribute of that name; empty where it has none, None without the attribute."""
        return next((a.value or "" for a in self.attributes() if a.name == name), None)

    def edited(self, change: Callable[[Attribute], str]) -> None:
        """Each attribute is replaced by change(attribute), its own text or another."""
        self.raw = _ATTRIBUTE.sub(lambda m: change(Attribute(m)), self.raw)

    def renamed(self, name: str) -> None:
        at = 1 + self.ends
        self.raw, self.name = f"{self.raw[:at]}{name}{self.raw[at + len(self.name) :]}", name


Piece = str | Tag


def scan(html: str) -> list[Piece]:
    out: list[Piece] = []
    at = 0
    for found in _TAG.finditer(html):
        if found.start() > at:
            out.append(html[at : found.start()])
        out.append(Tag(found))
        at = found.end()
    if at < len(html):
        out.append(html[at:])
    return out


def write(pieces: Iterable[Piece]) -> str:
    return "".join(p if isinstance(p, str) else p.raw for p in pieces)


def element_ends(pieces: list[Piece], names: set[str], balanced: bool = False) -> dict[int, int]:
    """Place of each start tag of `names` -> place of its end tag: the next one of the name, or, if balanced, the one that closes it. Those without one are left out."""
    out: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for k, p in enumerate(pieces):
        if isinstance(p, Tag) and p.name in names:
            held = open_at.setdefault(p.name, [])
            if not p.ends:
                held.append(k)
            elif held and balanced:
                out[held.pop()] = k
            else:
                out.update(dict.fromkeys(held, k))
                held.clear()
    return out


def without(pieces: list[Piece], names: set[str], wanted: Callable[[Tag], bool] = lambda tag: True, balanced: bool = False) -> list[Piece]:
    """Pieces without the elements of `names` that are `wanted`, content included. One without an end tag stays, but for a tag that closes itself."""
    ends = element_ends(pieces, names, balanced)
    out: list[Piece] = []
    skip = -1
    for k, p in enumerate(pieces):
        if k <= skip:
            continue
        if isinstance(p, Tag) and p.name in names and not p.ends and wanted(p):
            if k in ends:
                skip = ends[k]
                continue
            if p.closed:
                continue
        out.append(p)
    return out
