"""Leaf blocks of an HTML page, in page order, each with the features of its place and its text.

The page is scanned forward once, in time in proportion to its length, whatever its faults."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_SIGN = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not rendered, or is no text of the page.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
#: The slash at the end of a tag that stands for an end tag of its own, which only foreign elements have.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
#: A start tag on the left ends open elements on the right.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_HOLDERS = {"ul", "ol", "dl", "table", "tbody", "thead", "select", "article", "section", "div", "body", "nav", "aside", "main", "header", "footer", "form"}
_WORDS = (1, 4, 9, 19, 49)


def _names(attributes: str) -> list[str]:
    return ["in:" + p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")]


class _Page:
    """Open elements and the features that they give to the blocks inside."""

    def __init__(self, known: Callable[[str], bool]):
        self.known, self.stack, self.active = known, [], Counter()
        self.opened: Counter[str] = Counter()  # of each tag
        self.outer: list[str] = ["body"]  # open elements that are not inline
        self.near: list[tuple[int, list[str]]] = []

    def open(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE and any(t == "p" for t, _ in self.stack[-4:]):
            self.close("p")
        for other in _ENDS.get(tag, ()):
            self._close_sibling(other)
        names = _names(attributes)
        given = [f for f in {"under:" + tag, *names} if self.known(f)]
        self.active.update(given)
        self.stack.append((tag, given))
        self.opened[tag] += 1
        if tag not in _INLINE:
            self.outer.append(tag)
        if tag in _HOLDERS or names:  # what the nearest such element says counts besides what all of them say
            self.near.append((len(self.stack), [f for f in {"near:" + x.removeprefix("in:") for x in (tag, *names)} if self.known(f)]))

    def _close_sibling(self, tag: str) -> None:
        if not self.opened[tag]:
            return None
        for t, _ in reversed(self.stack):
            if t == tag:
                return self.close(tag)
            if t in _HOLDERS:
                return None
        return None

    def close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        while True:
            t, given = self.stack.pop()
            self.opened[t] -= 1
            if t not in _INLINE:
                self.outer.pop()
            if self.near and self.near[-1][0] > len(self.stack):
                self.near.pop()
            for f in given:
                self.active[f] -= 1
                if not self.active[f]:
                    del self.active[f]
            if t == tag:
                return

    def block(self, text: str, linked: int, first: bool) -> tuple[str, list[str]]:
        n, share = text.count(" ") + 1, linked / max(1, len(text))
        features = [f"is:{self.outer[-1]}", f"words:{sum(n > w for w in _WORDS)}", f"links:{(share > 0) + (share > 0.3) + (share > 0.7)}", "stop" if text[-1] in ".!?…。" else "no-stop"]
        features += ["copyright"] * ("©" in text) + ["first"] * first
        return text, [*self.active, *(self.near[-1][1] if self.near else ()), *filter(self.known, features)]


class _Scanner:
    """Finds the ends of tags. What is not there is looked for once."""

    def __init__(self, page: str):
        self.page, self.gone, self.quotes = page, set(), True

    def find(self, sign: str, at: int) -> int:
        if sign in self.gone:
            return -1
        if (found := self.page.find(sign, at)) < 0:
            self.gone.add(sign)
        return found

    def tag_end(self, at: int) -> int:
        """The `>` behind a tag's attributes; signs inside quoted values do not count, quotes that
        are never closed quote nothing. Once the page would end inside a tag, no quotes count any
        more. -1 if there is none."""
        begin = at
        if not self.quotes or self.find(">", at) < 0:
            return self.find(">", at)
        while m := _TAG_SIGN.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self.page[max(begin, at - 64) : at - 1].rstrip().endswith("=") and (close := self.find(m[0], at)) >= 0:
                at = close + 1
        self.quotes = False
        return self.find(">", begin)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) for texts, start and end tags, in their order. Comments,
    declarations and the content of raw elements are left out; a `<` that opens no tag is text."""
    scan, at, since = _Scanner(page), 0, 0
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = scan.find("-->", at + 4) if comment else scan.find(">", at)
            stop = len(page) if end < 0 else end + (3 if comment else 1)
            kind = None
        else:
            m = _NAME.match(page, at + (2 if after == "/" else 1))
            end = scan.tag_end(m.end()) if m else -1
            if end < 0:
                at += 1
                continue
            kind, stop = "end" if after == "/" else "start", end + 1
        if since < at:
            yield "text", page[since:at], ""
        if kind:
            tag, attributes = m[0].lower(), page[m.end() : end]
            yield kind, tag, attributes
            if kind == "start" and tag in _RAW and not (tag == "svg" and _CLOSED.search(attributes)):
                close = _RAW_END[tag].search(page, stop)
                stop = close.end() if close else len(page)
        at = since = stop
    if since < len(page):
        yield "text", page[since:], ""


def blocks(page: str, known: Callable[[str], bool] = lambda _: True) -> Iterator[tuple[str, list[str]]]:
    """(text, features) of each leaf block: a run of text between tags that are not inline.

    Character references are decoded and white space becomes one space. Unrendered elements,
    comments and markup are left out; a `<` that opens no tag is text."""
    state = _Page(known)
    parts: list[tuple[str, bool]] = []
    first = True

    def flush():
        nonlocal first
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            linked = sum(len(p) for p, in_link in parts if in_link)
            parts.clear()
            if text:
                yield state.block(text, linked, first)
                first = False

    for kind, tag, attributes in _tokens(page):
        if kind == "text":
            parts.append((tag, state.opened["a"] > 0))
            continue
        if tag in _RAW:
            continue
        if tag not in _INLINE:
            yield from flush()
        if kind == "end":
            state.close(tag)
        elif tag not in _VOID:
            state.open(tag, attributes)
    yield from flush()
