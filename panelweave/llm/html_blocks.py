"""A page as blocks of text: what HTML says about each, without a tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Element and attribute names of HTML, and words that sites use as class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head noscript template svg object select datalist option button canvas audio video".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title head html".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
ENDS_P = BLOCK - frozenset("body br caption head html legend li option optgroup summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("ul ol menu dl table thead tbody tfoot div section article main body".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
ASIDE_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination
    popup promo promoted recommended related respond share sharing sidebar signup social sponsor sponsored subscribe subscription
    toolbar widget widgets""".split()
)
ABOUT_LAYOUT = frozenset("has no with without".split())  # "with-sidebar" says what stands beside the element

TAG = re.compile(
    r"""<(?: !--(?:-?>|.*?(?:--!?>|\Z))
      | [!?][^>]*(?:>|\Z)
      | /(?![a-zA-Z])[^>]*(?:>|\Z)
      | (/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+)(?:>|\Z) )""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}

MARKED, HIDDEN, ARTICLE, MAIN = 1, 2, 4, 8


class Block(NamedTuple):
    tag: str  # the innermost block element
    marked: bool  # the markup declares it to stand beside the main text
    content: bool  # the markup declares it to be the main text
    text: str


def _state(name: str, attributes: str, state: int) -> int:
    """State inside an element, from that of its parent."""
    if name in SILENT:
        return state | HIDDEN
    if name == "article":
        state |= ARTICLE
    elif name == "main":
        state |= MAIN
    elif name in ASIDE:
        state |= MARKED
    if not attributes or "=" not in attributes:
        return state
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "role":
            role = value.strip().lower()
            state |= MARKED if role in ASIDE_ROLES else ARTICLE if role == "article" else MAIN if role == "main" else 0
        elif key.lower() == "itemprop":
            state |= ARTICLE if "articlebody" in value.lower().split() else 0
        elif name not in ("html", "body", "main"):
            for one in value.split():
                words = [w.lower() for w in WORD.findall(one)]
                if words and words[0] not in ABOUT_LAYOUT and not ASIDE_WORDS.isdisjoint(words):
                    state |= MARKED
    return state


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, white space inside each made one space, character references
    decoded. Scripts, styles, comments, form fields and the like give none. Elements that are left
    open end with their parent, and a page may end anywhere."""
    found: list[tuple[str, int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()

    def state() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                tag = next((n for n, _ in reversed(stack) if n in BLOCK), "")
                found.append((tag, state(), text))

    def pop_to(depth: int) -> None:
        outside = stack[depth - 1][1] if depth else 0
        if outside != state() or any(n in BLOCK for n, _ in stack[depth:]):
            flush()
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    def close(names, barrier) -> None:
        """End the innermost element with one of the names, if no barrier stands before it."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                pop_to(depth)
                return
            if barrier(stack[depth][0]):
                return

    def text(raw: str) -> None:
        if raw:
            if opened["head"] and not raw.isspace():
                close({"head"}, lambda n: False)
            if not state() & HIDDEN:
                pieces.append(html.unescape(raw) if "&" in raw else raw)

    at = 0
    while (tag := TAG.search(page, at)) is not None:
        text(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCK:
                flush()
            if opened[name]:
                close({name}, (lambda n: False) if name in BLOCK or name in SILENT else (lambda n: n in BLOCK))
            continue
        if opened["head"] and name not in HEAD_ONLY:
            close({"head"}, lambda n: False)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
        if name in ENDS_P and opened["p"]:
            close({"p"}, lambda n: n in BLOCK)
        if name in SIBLINGS and any(opened[n] for n in SIBLINGS[name]):
            close(SIBLINGS[name], HOLDERS.__contains__)
        if name not in VOID:
            inside = _state(name, tag[3], state())
            if inside != state():
                flush()
            stack.append((name, inside))
            opened[name] += 1
    text(page[at:])
    flush()
    told = [(t, bool(s & MARKED), s, x) for t, s, x in found if not s & HIDDEN]
    whole = ARTICLE if any(s & ARTICLE and not m for _, m, s, _ in told) else MAIN
    return [Block(t, m, bool(s & whole) and not m, x) for t, m, s, x in told]
