"""Leaf blocks of a page: runs of text between block-level tags, with what their ancestors are."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: An attribute's name and, if one is given, the place of its value.
_PART = re.compile(r"[\s/]*(=?[^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content isn't text of the page.
RAW = frozenset({"script", "style", "title", "textarea", "template", "iframe", "noframes", "xmp", "noembed"})
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
SKIPPED = frozenset({"head", "svg", "select", "datalist"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a run of text; formulas and embedded media, whose text is their content, too.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img audio canvas object video math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag ends an open element of these kinds, but none outside the container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: In a deep page a block has the names of its own element and of the nearest ancestors: of so many, and so many names.
ANCESTORS, NEAR = 64, 128


@dataclass
class Block:
    """text with white space made one blank and trimmed; above: names of ancestors and of their classes, ids and roles."""

    text: str
    above: frozenset[str]
    parent: str
    link_chars: int
    chars: int


@dataclass(slots=True)
class _Open:
    """An open element, its own names and parent; base: the place of the nearest element that isn't inline."""

    tag: str
    own: tuple[str, ...]
    parent: _Open | None
    skip: bool
    link: bool
    block: str
    base: int
    names: frozenset[str] | None = None

    def above(self) -> frozenset[str]:
        """Its names and those of its ancestors, the nearest first if they are many."""
        if self.names is None:
            found, x, last = set(self.own), self.parent, None
            for _ in range(ANCESTORS):
                if x is None or len(found) >= NEAR:
                    break
                if x.own is not last:
                    found.update(x.own[: NEAR - len(found)])
                last, x = x.own, x.parent
            self.names = frozenset(found)
        return self.names


@dataclass
class _Run:
    parts: list[str] = field(default_factory=list)
    at: _Open | None = None
    links: int = 0
    said: bool = False


def _names(attrs: list[tuple[str, str]]) -> set[str]:
    out = set()
    for kind, value in attrs:
        if kind in ("class", "id", "role"):
            value = _CAMEL.sub("-", value).lower()
            out.update(f"{'role' if kind == 'role' else 'name'}:{x}" for x in _NAME.findall(value))
    return out


def _hidden(attrs: list[tuple[str, str]]) -> bool:
    """Whether the attributes hide the element: hidden itself (but not "false"), or a style without display."""
    return any(k == "hidden" and unescape(v).strip().lower() != "false" or k == "style" and _NO_DISPLAY.search(unescape(v)) for k, v in attrs)


class _Tags:
    """Reads the tags of a page, each character a bounded number of times: a quote that never ends is looked for once."""

    def __init__(self, html: str):
        self.html = html
        self.unended: set[str] = set()

    def _find(self, text: str, at: int) -> int:
        """As str.find; what isn't found once isn't looked for again."""
        if text in self.unended:
            return -1
        k = self.html.find(text, at)
        if k < 0:
            self.unended.add(text)
        return k

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Names (lower case) and values of a tag from `at` on, the place after its end, and whether it ends with a slash.

        A value in quotes may hold anything, at any length; if its quote never ends, it ends at the next white space or >.
        """
        html, out, start = self.html, [], at
        while at < len(html) and html[at] != ">":
            m = _PART.match(html, at)
            at, value = m.end(), ""
            if m[2] and at < len(html):
                quote = html[at]
                end = self._find(quote, at + 1) if quote in "\"'" else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            if m[1] or m[2]:
                out.append((m[1].lower(), value))
        return out, at + 1, html[start:at].rstrip().endswith("/") if at - start < 99 else html[at - 1] == "/"


def blocks(html: str) -> tuple[list[Block], str]:
    """The page's leaf blocks in order, empty ones left out, and its title. Takes time in proportion to the page's length."""
    root = _Open("", (), None, False, False, "", 0)
    stack, out, run, title, at = [root], [], _Run(), "", 0
    tags, places, plain = _Tags(html), defaultdict(list), {}  # places: of open elements by tag; plain: names of tags alone

    def flush() -> None:
        nonlocal run
        if run.parts:
            text = " ".join("".join(run.parts).split())
            if text:
                out.append(Block(text, run.at.above(), run.at.block, run.links, len(text)))
            run = _Run()

    def say(text: str) -> None:
        top = stack[-1]
        if text and not top.skip:
            if run.at is None or not run.said:
                run.at = top
            run.said = run.said or not text.isspace()
            run.parts.append(text)
            if top.link:
                run.links += len(text.strip())

    def close(k: int) -> None:
        if any(x.tag not in INLINE for x in stack[k:]):
            flush()
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    def opened(tag: str, names: set[str]) -> None:
        top = stack[-1]
        inline = tag in INLINE
        hidden = tag in SKIPPED or bool(attrs) and _hidden(attrs)
        places[tag].append(len(stack))
        own = (tag, *sorted(names)) if names else plain.setdefault(tag, (tag,))
        stack.append(_Open(tag, own, top, top.skip or hidden, top.link or tag == "a", top.block if inline else tag, top.base if inline else len(stack)))

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            say(unescape(html[at:]))
            break
        if start > at:
            say(unescape(html[at:start]))
        m = _TAG.match(html, start + 1)
        if not m:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
            elif html.startswith("<![CDATA[", start):
                end = html.find("]]>", start + 9)
                say(html[start + 9 : end if end >= 0 else len(html)])
                at = end + 3 if end >= 0 else len(html)
            elif html[start + 1 : start + 2] in ("!", "?"):
                end = html.find(">", start + 2)
                at = end + 1 if end >= 0 else len(html)
            else:
                say("<")
                at = start + 1
            continue
        tag = m[2].lower()
        attrs, at, slash = tags.attributes(m.end())
        if m[1]:
            if places[tag] and (tag not in INLINE or places[tag][-1] > stack[-1].base):
                close(places[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P and stack[stack[-1].base].tag == "p":
            close(stack[-1].base)
        if tag in SIBLINGS:
            ends, inside = SIBLINGS[tag]
            edge = max((places[x][-1] for x in inside if places[x]), default=0)
            open_ = [places[x][k] for x in ends if (k := bisect_right(places[x], edge)) < len(places[x])]
            if open_:
                close(min(open_))
        if tag in RAW:
            end = _RAW_END[tag].search(html, at) if tag not in tags.unended else None
            if end is None:
                tags.unended.add(tag)
            if tag == "title" and not title:
                title = " ".join(unescape(html[at : end.start() if end else len(html)]).split())
            at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            flush()
        if tag == "body":  # whatever is open in the head ends
            close(1)
        if tag in VOID or slash and tag not in CLOSES_P:
            continue
        opened(tag, _names(attrs) if attrs else set())
    flush()
    return out, title
