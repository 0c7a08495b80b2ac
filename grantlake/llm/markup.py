"""HTML to a sequence of leaf blocks, tolerant of what pages hold: unclosed and crossed tags, raw text, character references."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Quotes hold a ">" only where they open an attribute's value; elsewhere a tag ends at the first one.
TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text ends at its closing tag, whatever else that tag holds.
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in ("script", "style")}
#: An opening tag closes these, as far as no tag of the second set lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu table dl select".split())
#: Elements that don't close an open paragraph.
IN_PARAGRAPH = frozenset("button iframe noscript option optgroup select template textarea video audio canvas".split())


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: float


class Walker:
    """Open elements, their names and the words in their class, id and role."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.size = 0
        self.blocks: list[Block] = []

    def push(self, name: str, attributes: str) -> None:
        words = [name]
        if "=" in attributes:
            for kind, a, b, c in ATTRIBUTE.findall(attributes):
                words += [f".{w.lower()}" for w in PART.findall(a or b or c)]
        self.stack.append((name, tuple(words)))
        self.open.update(words)
        self.names[name] += 1

    def pop(self) -> None:
        name, words = self.stack.pop()
        self.names[name] -= 1
        for w in words:
            self.open[w] -= 1
            if not self.open[w]:
                del self.open[w]

    def close(self, name: str) -> None:
        if self.names[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def close_before(self, name: str) -> None:
        if name in BLOCKS and name not in IN_PARAGRAPH and self.names["p"]:
            self.close("p")
        for other in CLOSES.get(name, ()):
            if self.names[other]:
                for there, _ in reversed(self.stack):
                    if there in SCOPES:
                        break
                    if there == other:
                        self.close(other)
                        break

    def say(self, text: str) -> None:
        self.parts.append(text)
        n = len(text)
        self.size += n
        if self.names["a"]:
            self.linked += n

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                leaf = tuple(f"@{w}" for w in self.stack[-1][1]) if self.stack else ()
                self.blocks.append(Block(text, (*self.open, *leaf), self.linked / max(self.size, 1)))
            self.parts = []
            self.linked = self.size = 0


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: text with references decoded and white space made one space, the
    words of its path, and the share of its text that lies in links."""
    walk = Walker()
    at = 0
    position = 0
    # No tag ends after the last ">"; looking further would read the rest once per "<".
    stop = page.rfind(">") + 1
    while match := TOKENS.search(page, position, stop):
        if match.start() > at:
            walk.say(page[at : match.start()])
        at = position = match.end()
        name = match[2]
        if not name:
            if match[0].startswith("<!--") and not match[0].endswith("-->"):
                at = len(page)
                break
            continue
        name = name.lower()
        if match[1]:
            if name in BLOCKS:
                walk.flush()
            if name == "p" and not walk.names["p"]:
                continue
            walk.close(name)
            continue
        if name == "br":
            walk.say(" ")
            continue
        if name in BLOCKS:
            walk.flush()
            walk.close_before(name)
        if name in RAW_ENDS:
            end = RAW_ENDS[name].search(page, at)
            at = position = end.end() if end else len(page)
            continue
        if name in VOID or page[match.end() - 2] == "/" and name not in BLOCKS:
            continue
        walk.push(name, match[3])
    if rest := page[at:].partition("<!--")[0]:
        walk.say(rest)
    walk.flush()
    return walk.blocks
