"""The visible blocks of a web page, and which of them belong to its article."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_NAME = re.compile(r"""</?([a-zA-Z][^\s/<>"']*)""")
_MARK = re.compile(r"""[<>"']""")
# A tag without angle brackets in its attributes; the search ends at the next bracket.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)([^<>"']*(?:(?:"[^"<>]*"|'[^'<>]*')[^<>"']*)*)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page; it is skipped up to the end tag, whatever is inside.
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas audio video select".split())
#: Elements beside an article.
ASIDE = frozenset("nav footer aside form button dialog menu label fieldset head".split())
BLOCK = frozenset(
    "html body main article section header footer nav aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "blockquote pre table thead tbody tfoot tr caption figure figcaption hr address details summary".split()
)
_SPACED = frozenset("br td th".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OWN_END = frozenset("p li dt dd tr td th".split())
_NAMES = (
    "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|"
    "notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|sidebar|widget|menu|nav|navbar|"
    "navigation|breadcrumb|breadcrumbs|footer|masthead|comment|comments|disqus|respond|reply|replies|share|sharing|social|"
    "related|recommended|recommendations|pagination|pager|toolbar|login|search|copyright|skip"
)
_BESIDE = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])", re.I)
_NOT_THE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|ads?|advert\w*|sponsored|promo|related|teaser)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())


class Page(NamedTuple):
    article: list[str]  # blocks of the article, without what stands beside it
    rest: list[str]  # blocks outside any article that no element marks as furniture
    furniture: list[str]  # blocks that an element, class or role marks as furniture
    has_article: bool


class _Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str  # empty for comments and declarations
    attributes: str


class _Tags:
    """The tags of a page in order, in time proportional to its length.

    A tag ends at the first ``>`` outside quotes.  Where none follows, the ``<`` is
    text; so is every later one that such a fruitless search passed outside quotes,
    since its own search would go the same way.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.fruitless: set[int] = set()

    def _end(self, at: int) -> int:
        source, passed = self.source, []
        while mark := _MARK.search(source, at):
            at = mark.end()
            if mark[0] == ">":
                return at
            if mark[0] == "<":
                if mark.start() in self.fruitless:
                    break
                passed.append(mark.start())
            else:
                at = source.find(mark[0], at) + 1
                if not at:
                    break
        self.fruitless.update(passed)
        return -1

    def next(self, at: int) -> _Tag | None:
        source = self.source
        while 0 <= (start := source.find("<", at)) < self.last:
            at = start + 1
            if plain := _PLAIN.match(source, start):
                return _Tag(start, plain.end(), plain[1] == "/", plain[2].lower(), plain[3])
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return _Tag(start, len(source) if end < 0 else end + 3, False, "", "")
            if source[at] in "!?":
                return _Tag(start, source.index(">", at) + 1, False, "", "")
            name = _NAME.match(source, start)
            if name is None or start in self.fruitless:
                continue
            end = self._end(name.end())
            if end < 0:
                self.fruitless.add(start)
                continue
            return _Tag(start, end, source[at] == "/", name[1].lower(), source[name.end() : end - 1])
        if source.find("<!--", at) >= 0:  # an open comment hides the rest, also without any tag behind it
            start = source.find("<!--", at)
            return _Tag(start, len(source), False, "", "")
        return None


def _attributes(text: str) -> dict[str, str]:
    return {n.lower(): html.unescape(v.strip("\"'")) for n, v in _ATTRIBUTE.findall(text)}


def _is_beside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    own = _attributes(attributes)
    names = f"{own.get('class', '')} {own.get('id', '')}"
    if tag in ("article", "main"):
        return bool(_NOT_THE_ARTICLE.search(names))
    if tag in ("html", "body"):
        return False
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
    return hidden or own.get("role", "").lower() in _ROLES or bool(_BESIDE.search(names))


def read_page(source: str) -> Page:
    """Blocks of ``source`` in page order, white space collapsed and character references decoded.

    ``article`` elements are the article; without any, a ``main`` element is.
    An unclosed furniture element ends with the article, main or body around it;
    articles inside it, as comments often are, end before that.
    """
    page = Page([], [], [], bool(re.search(r"<article[\s>]", source, re.I)))
    core = "article" if page.has_article else "main"
    parts: list[str] = []
    depth, skip, skip_depth, inner, at = 0, "", 0, 0, 0
    found_core, tags, endless = False, _Tags(source), set()

    def flush() -> None:
        if parts:
            block = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if block:
                (page.furniture if skip else page.article if depth else page.rest).append(block)

    while True:
        tag = tags.next(at)
        text = source[at : tag.start if tag else len(source)]
        if text:
            parts.append(html.unescape(text) if "&" in text else text)
        if not tag:
            break
        at, closing, name = tag.end, tag.closing, tag.name
        if not name:
            continue
        if name in RAW and not closing:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else at if name == "select" else len(source)
            continue
        if name in _SPACED:
            parts.append(" ")
        if name in BLOCK or name in ASIDE:
            flush()
        if name in _VOID or not closing and tag.attributes.endswith("/") and name not in BLOCK:
            continue
        if skip:
            if name == skip and (closing or skip not in _OWN_END):
                skip_depth += -1 if closing else 1
                if not skip_depth:
                    flush()
                    skip = ""
                    continue
            elif name == core and depth and (not closing or inner):
                inner += -1 if closing else 1
                continue
            elif (closing and name in (core, "body")) or (not closing and (name == core and not depth or skip in _OWN_END and name in BLOCK)):
                flush()
                skip = ""
            else:
                continue
        if name == core and closing:
            flush()
            depth = max(0, depth - 1)
        elif not closing:
            if _is_beside(name, tag.attributes, depth > 0):
                flush()
                skip, skip_depth, inner = name, 1, 0
            elif name == core:
                flush()
                depth += 1
                found_core = True
    flush()
    return page._replace(has_article=found_core)
