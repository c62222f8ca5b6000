"""Raw HTML as a flat list of events: elements that open and close, and text. One pass, linear in the page's length.

Attributes are read pair by pair as browsers do: a quote counts only after an equals sign, a value without its closing
quote ends at the tag's end. Whatever is searched for and missing once (a closing quote, the end of a comment) is not
searched for again. Elements that end without a tag are closed where they end, so every open event has its close event.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Elements of the HTML standard by what they do to the tree
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noscript template svg".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html li summary tbody td tfoot th thead title tr".split())
CLOSES_SAME = frozenset("li dt dd tr td th option".split())
INLINE = frozenset("a abbr b big cite code em font i mark q s small span strike strong sub sup tt u".split())
#: Elements that a head may hold; any other block ends it, as its end tag is optional.
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

BOILERPLATE = frozenset("nav aside footer form head title button select textarea menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar form dialog alert alertdialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments commentlist disqus replies cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended pagination pager toolbar widget".split()
)
#: Words that go with the above in one name without another subject: site-footer, related-posts, but not related-work.
BESIDE = frozenset(
    "area bar block blocks body bottom box button buttons col column container content footer global group header icon icons inner item items js left link links "
    "list main mobile outer page panel placeholder post posts primary right row secondary section site slot top unit wrap wrapper zone".split()
)
ARTICLES = frozenset("article main".split())
#: Words that say of a name that it tells how the page is laid out: no-sidebar, has-menu.
LAYOUT = frozenset("no not non without has have with".split())

_plain = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:\s++[^\s\"'<>/=]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?+)*+)\s*+(/?)>")
_name = re.compile(r"[^\s/>]*+")
_space = re.compile(r"[\s/]*+")
_key = re.compile(r"[^\s/>=]?[^\s/>=]*+")
_equals = re.compile(r"\s*+=\s*+")
_bare = re.compile(r"[^\s>]*+")
_part = re.compile(r"[a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Ends:
    """Searches in one page that give up for good once a thing is missing."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_tag(self, name: str, at: int) -> tuple[int, int] | None:
        """Bounds of the next end tag of that name."""
        if "</" + name in self.missing:
            return None
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(self.page, at)
        if m is None:
            self.missing.add("</" + name)
        return m and m.span()


def _attributes(page: str, at: int, ends: _Ends) -> tuple[list[tuple[str, str]], bool, int]:
    """Pairs of a tag from the end of its name, whether it closes itself, and where it ends."""
    pairs, n = [], len(page)
    while True:
        at = _space.match(page, at).end()
        if at >= n or page[at] == ">":
            return pairs, page[at - 1] == "/", min(at + 1, n)
        m = _key.match(page, at)
        key, at = m[0] or page[at], max(m.end(), at + 1)
        m = _equals.match(page, at)
        value = ""
        if m:
            at = m.end()
            quote = page[at : at + 1]
            end = ends.find(quote, at + 1) if quote in ('"', "'") else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                m = _bare.match(page, at)
                value, at = m[0].lstrip("\"'"), m.end()
        pairs.append((key.lower(), value))


def tags(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]] | None, bool]]:
    """("text", text, None, False), or ("open" or "close", name, attribute pairs, whether the tag closes itself)."""
    ends, at, n = _Ends(page), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : lt if lt >= 0 else n], None, False
            if lt < 0:
                return
        m = _plain.match(page, lt)
        if m:
            name, at = m[2].lower(), m.end()
            if m[1]:
                yield "close", name, None, False
                continue
            pairs = _attributes(m[3], 0, _Ends(m[3]))[0] if m[3] else []
            own = bool(m[4])
        elif page.startswith("<!--", lt):
            end = ends.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
            continue
        elif page.startswith(("<!", "<?"), lt):
            what = "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = ends.find(what, lt)
            end = end if end >= 0 else ends.find(">", lt)
            at = end + len(what) if end >= 0 else n
            continue
        else:
            close = page.startswith("</", lt)
            first = page[lt + 1 + close : lt + 2 + close]
            if not (first.isascii() and first.isalpha()):
                if close and first:  # a bogus comment
                    end = ends.find(">", lt)
                    at = end + 1 if end >= 0 else n
                    continue
                yield "text", "<", None, False
                at = lt + 1
                continue
            name = _name.match(page, lt + 1 + close)[0].lower()
            pairs, own, at = _attributes(page, lt + 1 + close + len(name), ends)
            if close:
                yield "close", name, None, False
                continue
        if name in RAW and not (own and name == "svg"):
            span = ends.end_tag(name, at)
            if span or name in ("script", "style"):  # what never ends is the rest of the page; of the others, nothing
                at = span[1] if span else n
            continue
        if name not in RAW:
            yield "open", name, pairs, own


@dataclass(slots=True)
class Element:
    name: str
    path: int  # a number for its place: the names and classes of it and what it stands in
    boilerplate: bool
    article: bool
    block: int
    solid: int = 0  # how deep the nearest element stands that is not inline, itself included


@dataclass(slots=True)
class Event:
    """kind is open, close or text; block numbers the blocks of the page, text of equal block follows in one line."""

    kind: str
    path: int
    block: tuple[int, int] | None = None
    boilerplate: bool = False
    article: bool = False
    text: str = ""


class Places:
    """Numbers for the places that elements stand in, shared by the pages of a host."""

    def __init__(self):
        self.known: dict[tuple[int, str, str], int] = {}
        self.names: list[str] = [""]
        self.boilerplate: list[bool] = [False]
        self.article: list[bool] = [False]
        self.heading: list[bool] = [False]

    def of(self, above: Element, name: str, pairs: list[tuple[str, str]]) -> int:
        names, role, hidden = "", "", False
        for key, value in pairs:
            if key == "role":
                role = value.lower()
            elif key in ("class", "id"):
                names += " " + value
            elif key in ("hidden", "aria-hidden"):
                hidden |= key == "hidden" or value.lower() == "true"
        key = (above.path, name, f"{names}\0{role}\0{hidden}" if pairs else "")
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.names)
            each = [frozenset(_part.findall(_camel.sub(" ", x).lower())) for x in names.split()]
            article = above.article or name in ARTICLES or role in ARTICLES or (bool(ARTICLES) and "articlebody" in names.lower())
            named = name not in ("html", "body", "article", "main") and any(LAYOUT.isdisjoint(x) and not NAMES.isdisjoint(x) and x <= NAMES | BESIDE for x in each)
            self.names.append(name)
            self.boilerplate.append(above.boilerplate or hidden or name in BOILERPLATE or role in ROLES or (name == "header" and "nav" in BOILERPLATE and not above.article) or named)
            self.article.append(article)
            self.heading.append(self.heading[above.path] or name in HEADINGS)
        return found


def parse(page: str, places: Places) -> list[Event]:
    """Events in order; every element that opens closes."""
    out, stack, nth = [], [Element("", 0, False, False, 0)], 0

    open_: dict[str, list[int]] = {}  # where in the stack elements of a name are

    def close(at: int) -> None:
        for e in reversed(stack[at:]):
            out.append(Event("close", e.path))
            open_[e.name].pop()
        del stack[at:]

    def last(*names: str) -> int:
        return max((open_[x][-1] for x in names if open_.get(x)), default=0)

    for kind, name, pairs, own in tags(page):
        top = stack[-1]
        if kind == "text":
            out.append(Event("text", top.path, (top.block, nth), top.boilerplate, top.article, name))
            continue
        nth += name in BLOCKS
        if kind == "close":
            at = last(name)
            if at:
                close(at)
        elif name == "br":
            out.append(Event("text", top.path, (top.block, nth), top.boilerplate, top.article, " "))
        elif name not in VOID:
            if name in BLOCKS and name not in IN_HEAD and (at := last("head")):
                close(at)
            if name in CLOSES_P:  # an open paragraph, and inline elements left open in it, end here
                at = stack[-1].solid
                if stack[at].name == "p":
                    close(at)
            elif name in CLOSES_SAME:
                at = last(name, "ul", "ol", "dl", "table")
                if at and stack[at].name == name:
                    close(at)
            above, at = stack[-1], len(stack)
            path = places.of(above, name, pairs)
            stack.append(Element(name, path, places.boilerplate[path], places.article[path], nth if name in BLOCKS else above.block, above.solid if name in INLINE else at))
            open_.setdefault(name, []).append(at)
            out.append(Event("open", path))
            if own:
                close(at)
    close(1)
    return out
