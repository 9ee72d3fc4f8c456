"""Blocks of an HTML page: runs of text between block-level tags, with what surrounds them.

One pass over the markup by a single pattern; nothing is repaired but what text needs: implied ends of paragraphs, list
items and cells, unclosed and stray tags, unclosed comments, raw text elements and tags cut off by the end of the page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# A quote counts only after an equals sign; a tag that the page's end cuts off is dropped with what follows its start.
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?P<close>>|\Z)|</[^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = {"article", "main"}
# elements whose text is never part of an article
APART = {"nav", "footer", "aside", "form", "noscript", "template", "svg", "button", "select", "dialog", "menu", "object", "audio",
         "video", "canvas", "head", "datalist", "fieldset"}
BLOCKS = HEADINGS | CONTENT | APART | {
    "html", "body", "p", "div", "section", "header", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody",
    "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address", "hr", "center", "details", "summary", "hgroup",
    "search", "option", "optgroup", "legend", "dir", "listing"}
# start tag -> elements it ends, up to the nearest element that holds such items
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select", "datalist"})}
# words of class and id names, and roles, that mark what stands beside an article
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "masthead", "topbar", "cookie",
    "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "social", "share", "sharing", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "respond",
    "reply", "replies", "disqus", "pagination", "pager", "toolbar", "copyright", "disclaimer", "search", "paywall", "complementary",
    "contentinfo", "dialog", "alertdialog", "menubar", "form", "skip", "hidden"}
MAIN_WORDS = {"article", "articlebody", "main", "maincontent", "story", "storybody", "post", "postbody", "entry"}
NOT_A_HINT = {"has", "with", "no", "without"}      # "with-sidebar" describes a page, not a sidebar


@dataclass
class Block:
    """Text of one block, white space made single blanks."""
    text: str
    heading: bool
    apart: bool            # inside an element that is never part of an article
    container: int         # number of the innermost article element, 0 outside of all
    linked: int            # characters inside links
    parent: int            # number of the element around the block's own


@dataclass
class _Open:
    tag: str
    apart: bool
    container: int
    number: int = 0


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, 0)])
    containers: int = 0
    elements: int = 0
    begun: set[int] = field(default_factory=set)       # article elements that have a block already
    link: bool = False


def _words(value: str) -> list[str]:
    return [w.lower() for w in HINT.findall(value)]


def _marks(words: list[str], known: set[str]) -> bool:
    return any(w in known and (i == 0 or words[i - 1] not in NOT_A_HINT) for i, w in enumerate(words))


def _opened(tag: str, attrs: str, parent: _Open, state: _State) -> _Open:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    names = [w for v in (found.get("class", ""), found.get("id", "")) for part in v.split() for w in [*_words(part), ""]]
    role = _words(found.get("role", ""))
    banner = tag == "header" or tag == "div" and _marks(names, {"header"}) and not _marks(names, MAIN_WORDS)
    # an article's own header stands on top of it
    apart = parent.apart or tag in APART or banner and (not parent.container or parent.container in state.begun)
    if tag not in ("html", "body"):
        style = found.get("style", "").replace(" ", "").lower()
        apart = (apart or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
                 or _marks(role, ASIDE_WORDS | {"navigation"}) or tag not in CONTENT | HEADINGS and _marks(names, ASIDE_WORDS)
                 or tag == "article" and _marks(names, {"comment", "comments", "reply", "related", "teaser", "ad", "promo"}))
    main = tag in CONTENT or "main" in role or "articlebody" in found.get("itemprop", "").lower() or (
        tag in ("div", "section", "td") and _marks(names, MAIN_WORDS))
    container = parent.container
    if main and not apart:
        state.containers += 1
        container = state.containers
    state.elements += 1
    return _Open(tag, apart, container, state.elements)


def blocks(page: str) -> list[Block]:
    """Non-empty blocks in page order.  A line break is white space, two in a row end a block."""
    out: list[Block] = []
    state = _State()
    stack = state.stack
    pieces: list[str] = []
    linked = 0
    breaks = 0

    def flush() -> None:
        nonlocal linked, breaks
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                top = stack[-1]
                state.begun.add(top.container)
                out.append(Block(text, any(o.tag in HEADINGS for o in stack[-3:]), top.apart, top.container, linked,
                                 stack[max(0, len(stack) - 2)].number))
        linked = breaks = 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if not text.isspace():
            breaks = 0
            if state.link:
                linked += len(text.strip())

    at = 0
    lower = None
    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or not m["close"]:
            continue
        if tag in RAW and not m["end"]:
            lower = lower if lower is not None else page.lower()
            if len(lower) != len(page):        # a few capital letters change their length in lower case
                stop = re.compile(rf"</{tag}", re.I).search(page, at)
                at = stop.start() if stop else len(page)
            else:
                stop = lower.find(f"</{tag}", at)
                at = stop if stop >= 0 else len(page)
            continue
        if tag == "a":
            state.link = not m["end"] and "href" in m["attrs"].lower()
        elif tag == "br":
            add(" ")
            breaks += 1
            if breaks > 1:
                flush()
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if m["end"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth:
                    del stack[depth:]
                if stack[-1].tag in APART | CONTENT or tag in APART | CONTENT:
                    state.link = False
                continue
            if stack[-1].tag == "p":
                stack.pop()
            if tag in IMPLIED:
                ended, within = IMPLIED[tag]
                depth = len(stack) - 1
                while depth > 0 and stack[depth].tag not in within:
                    if stack[depth].tag in ended:
                        del stack[depth:]
                    depth -= 1
            if tag == "body":
                del stack[1:]
            stack.append(_opened(tag, m["attrs"], stack[-1], state))
        elif tag not in VOID and ("class" in m["attrs"] or "hidden" in m["attrs"] or "style" in m["attrs"]) and not m["end"]:
            inline = _opened(tag, m["attrs"], stack[-1], state)
            if inline.apart and not stack[-1].apart:      # an inline element set apart is a block of its own
                flush()
                stack.append(inline)
        elif m["end"] and stack[-1].tag == tag:
            flush()
            stack.pop()
    flush()
    return out
