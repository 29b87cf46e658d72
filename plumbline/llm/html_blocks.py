"""Cutting HTML into leaf blocks of text, each with its path of tags."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from typing import NamedTuple

# fixed values: names of HTML elements
RAW = frozenset("script style template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^\"'>]*")
_LONG_NUMBER = re.compile(r"&#[0-9]{1000,};?")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PART = re.compile(r"[a-z]+")


class Path:
    """An open block-level element: its parent, how deep it is, and those of its tokens that no element around it has.

    Tokens are tags, and words of their classes, ids and roles.  Elements share the paths of those around them, so a page
    takes memory in proportion to its length, however deep it is.
    """

    __slots__ = ("depth", "new", "parent", "vector")

    def __init__(self, parent: Path | None, new: tuple[str, ...], depth: int):
        self.parent, self.new, self.depth, self.vector = parent, new, depth, None

    def tokens(self) -> list[str]:
        out, node = [], self
        while node is not None:
            out.extend(node.new)
            node = node.parent
        return out


class _Open:
    """The elements that are open now, each with the path that text in it has."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.paths = [Path(None, (), 0)]  # of the block-level ones, behind that of the page
        self.block_at: list[int] = []  # where those stand in the stack
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # and where each tag does
        self.times: Counter[str] = Counter()  # of tokens

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.at[tag].append(len(self.stack))
        if tag not in INLINE:
            new = tuple(n for n in dict.fromkeys(names) if not self.times[n])
            self.times.update(names)
            self.block_at.append(len(self.stack))
            self.paths.append(Path(self.paths[-1], new, self.paths[-1].depth + len(names)))
        self.stack.append((tag, names))

    def cut(self, k: int) -> None:
        """Closes the element at ``k`` and all within it."""
        while len(self.stack) > k:
            tag, names = self.stack.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.times.subtract(names)
                self.block_at.pop()
                self.paths.pop()


class Part(NamedTuple):
    """A piece of a page: text, a tag, or, with neither, other markup."""

    end: int
    text: str | None = None
    closes: bool = False
    tag: str | None = None
    attributes: str = ""


class Scanner:
    """Cuts a page into its parts, in time proportional to its length whatever it holds.

    A tag ends at the first > outside quotes; if its quotes don't close, at the first > of all.  A < that nothing closes
    is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.failed: set[int] = set()  # quotes from which no tag's end is reached

    def part(self, at: int) -> Part:
        page = self.page
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            return Part(end, page[at:end])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return Part(len(page) if end < 0 else end + 3)
        if at < self.last:
            if named := _NAME.match(page, at):
                end = self._balanced(named.end())
                if end < 0 and not named[1]:
                    end = page.find(">", named.end()) + 1
                if end > 0:
                    return Part(end, None, bool(named[1]), named[2], page[named.end() : end - 1])
            if page[at + 1] in "!?/":
                return Part(page.find(">", at) + 1)
        return Part(at + 1, "<")

    def _balanced(self, at: int) -> int:
        """Behind the first > outside quotes, or -1.  Where one search has failed, no later one looks again."""
        seen = []
        while True:
            i = _PLAIN.match(self.page, at).end()
            if i < len(self.page) and self.page[i] == ">":
                return i + 1
            close = -1 if i == len(self.page) or i in self.failed else self.page.find(self.page[i], i + 1)
            seen.append(i)
            if close < 0:
                self.failed.update(seen)
                return -1
            at = close + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the closing tag of an element whose content isn't read, or -1."""
        found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, at, max(at, self.last + 1))
        return found.end() if found else -1


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # characters inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{tag}>"]
    for found in _NAMED.finditer(attributes):
        out += [f".{x}" for x in _NAME_PART.findall(next(g for g in found.groups() if g is not None).lower())]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The page's runs of text between block-level tags, in order, blank ones left out.

    Character references are decoded and white space becomes single spaces.  Elements whose content isn't running
    text are skipped whole; of one that is never closed, only the tag is.  Another tag that is never closed ends with
    its parent.
    """
    out: list[Block] = []
    open_ = _Open()
    unclosed: set[str] = set()
    held: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        text = _LONG_NUMBER.sub("\ufffd", "".join(held))  # no character has such a number
        text = " ".join(html.unescape(text).split())
        if text:
            out.append(Block(text, open_.paths[-1], min(linked, len(text))))
        held.clear()
        linked = 0

    scanner = Scanner(page)
    while at < len(page):
        part = scanner.part(at)
        at = part.end
        if part.tag is None:
            if part.text:
                held.append(part.text)
                if open_.at["a"]:
                    linked += len(part.text)
            continue
        tag, attributes = part.tag.lower(), part.attributes
        if part.closes:
            if tag not in INLINE:
                flush()
            k = open_.at[tag][-1] if open_.at[tag] else None
            if k is not None and (tag not in INLINE or not open_.block_at or open_.block_at[-1] < k):
                open_.cut(k)
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = -1 if tag in unclosed else scanner.raw_end(tag, at)
            if end < 0:
                unclosed.add(tag)
            else:
                at = end
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID or attributes.endswith("/"):
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            closes = {"p"} if tag in ENDS_PARAGRAPH else {tag} if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else set()
            if open_.block_at and open_.stack[open_.block_at[-1]][0] in closes:
                open_.cut(open_.block_at[-1])
        open_.push(tag, _names(tag, attributes))
    flush()
    return out
