"""Web pages as sequences of leaf blocks, each with its text and the path of elements around it."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^>]*+)>"""
    r"""|<[!?/a-zA-Z][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What follows a name in a tag that closes itself; a slash that ends a value without quotes is part of that.
_CLOSED = re.compile(r"""(?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+(?=\s))|"[^"]*"|'[^']*')*/""")
#: Paths that a worker keeps; when full, it starts anew.
MOST_PATHS = 50_000
#: Elements inside which text goes on in the block around, elements without content, and those whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg".split())
#: Elements that a slash at the end of their start tag closes at once.
FOREIGN = frozenset(["svg", "math"])
#: An element of the key ends open ones of the same list, up to an element of the second.
_SIBLINGS = {
    **dict.fromkeys(["li"], (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(["dt", "dd"], (("dt", "dd"), ("dl",))),
    **dict.fromkeys(["td", "th"], (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(["tr"], (("tr", "td", "th"), ("table",))),
    **dict.fromkeys(["option"], (("option",), ("select",))),
}


class Path:
    """An element around blocks: its name, the words of its class, id and role, and the path around it. The outermost one has no name."""

    __slots__ = ("around", "tag", "words")

    def __init__(self, around: Path | None = None, tag: str = "", words: tuple[str, ...] = ()):
        self.around, self.tag, self.words = around, tag, words

    def outwards(self) -> Iterator[Path]:
        """The elements from this one to the outermost."""
        at = self
        while at.around is not None:
            yield at
            at = at.around

    @property
    def tags(self) -> tuple[str, ...]:
        """Names from the outermost element to this one."""
        return tuple(p.tag for p in self.outwards())[::-1]


@dataclass
class Block:
    path: Path
    text: str
    link_chars: int


def _words(rest: str) -> tuple[str, ...]:
    found = {t.lower() for m in _ATTRIBUTE.finditer(rest) for t in _TOKEN.findall(m[2] or m[3] or m[4] or "")}
    return tuple(sorted(found))


class Parser:
    """Paths are shared between blocks and pages, so that what is worked out for one can be kept by identity."""

    def __init__(self) -> None:
        self.root = Path()
        #: By the identity of a path, which is kept beside its child so that no other object gets it.
        self.children: dict[tuple[int, str, str], tuple[Path, Path]] = {}

    def child(self, path: Path, tag: str, rest: str) -> Path:
        key = (id(path), tag, rest)
        if (found := self.children.get(key)) is None:
            if len(self.children) >= MOST_PATHS:
                self.children.clear()
            found = self.children[key] = path, Path(path, tag, _words(rest))
        return found[1]

    def blocks(self, page: str) -> Iterator[Block]:
        """The blocks of a page in order. Text of scripts, styles, comments and the like is none.

        Each tag costs the same however deep it is: the places of open elements are kept by name.
        """
        stack: list[tuple[str, Path]] = []
        places: dict[str, list[int]] = defaultdict(list)  # in the stack
        outer: list[int] = []  # places of elements that aren't inline
        path, pieces, linked = self.root, [], 0

        def flush() -> Iterator[Block]:
            nonlocal pieces, linked
            if pieces:
                text = "".join(pieces)
                text = " ".join((html.unescape(text) if "&" in text else text).split())
                if text:
                    yield Block(path, text, linked)
                pieces, linked = [], 0

        def close(depth: int) -> None:
            nonlocal path
            while len(stack) > depth:
                gone, _ = stack.pop()
                places[gone].pop()
                if gone not in INLINE:
                    outer.pop()
            path = stack[-1][1] if stack else self.root

        def last(names: tuple[str, ...]) -> int:
            return max((places[n][-1] for n in names if places[n]), default=-1)

        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                pieces.append(text)
                if places["a"]:
                    linked += len(text.strip())
            if not m:
                break
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name, rest = name.lower(), m["rest"] if m["name"] else m["rest2"]
            inline = name in INLINE
            if not inline:
                yield from flush()
            elif name == "br":
                pieces.append(" ")
            if m["end"] or m["end2"]:
                # An inline element is closed within its block only.
                depth = last((name,))
                if depth >= 0 and not (inline and outer and outer[-1] > depth):
                    close(depth)
                continue
            if name in FOREIGN and rest.endswith("/") and _CLOSED.fullmatch(rest):
                continue
            if name in RAW:
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            if name in VOID:
                continue
            if not inline:
                # A paragraph ends where another block begins.
                if outer and stack[outer[-1]][0] == "p":
                    close(outer[-1])
                if name in _SIBLINGS:
                    own, stops = map(last, _SIBLINGS[name])
                    if own > stops:
                        close(own)
            path = path if inline else self.child(path, name, rest)
            places[name].append(len(stack))
            if not inline:
                outer.append(len(stack))
            stack.append((name, path))
        yield from flush()
