"""A tolerant reading of raw HTML into text blocks with their place in the page.

One pass over the tags of a page with a stack of open elements. Raw-text elements
(scripts, styles, ...) and comments hold no text; unclosed paragraphs, items and
cells end where HTML ends them. A *path* is the chain of block elements with their
classes (digits left out), as a 64-bit hash; inline elements have none.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import xxhash

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp "
                   "small span strike strong sub sup time tt u var".split())
BREAKS = frozenset({"br"})
#: Elements that end an open paragraph when they begin.
ENDS_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td "
                   "tfoot th thead tr ul".split())
#: An element of the key ends an open one of the values, up to the list or table they are in.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select menu html body article section div".split())

# Declared roles (fixed word lists): what these elements or classes hold is not the article.
NOISE_TAGS = frozenset("nav footer aside form header menu button select dialog head search".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
                        "cookies consent gdpr notice alert newsletter subscribe popup modal overlay sidebar menu nav navbar "
                        "navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended "
                        "widget toolbar pagination pager login signup search form complementary contentinfo dialog".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond discussion".split())
MAIN_TAGS = frozenset({"article", "main"})
#: A class with one of these says how the page is laid out (``with-sidebar``), not what the element is.
LAYOUT_WORDS = frozenset({"with", "has", "no", "without"})
MAX_DEPTH = 64

#: WRAPPED: an article in an element with a noise class, which stays only if nothing else does.
CLEAR, WRAPPED, SOFT, HARD = 0, 1, 2, 3


class Block(NamedTuple):
    """Text of a block; ``noise``: in an element declared not to be content (CLEAR if not); ``main``: length of
    the chain down to the article it is in, 0 without one."""

    text: str
    path: int
    chain: tuple[int, ...]
    noise: int
    main: int
    link_chars: int


class Page(NamedTuple):
    blocks: list[Block]
    children: dict[int, list[int]]  # path to the paths of its children, repeats in a row once


_IDS: dict[tuple[int, str], int] = {}


def _path(parent: int, name: str) -> int:
    key = (parent, name)
    found = _IDS.get(key)
    if found is None:
        if len(_IDS) > 200_000:
            _IDS.clear()
        found = _IDS[key] = xxhash.xxh64_intdigest(f"{parent} {name}") >> 1
    return found


def _declared(tag: str, attrs: str, inside_main: int) -> tuple[str, int]:
    """The element's name for its path, and whether it is declared noise."""
    name, noise = tag, CLEAR
    if tag in NOISE_TAGS and not (tag == "header" and inside_main):
        noise = HARD
    if attrs:
        words: set[str] = set()
        for m in _ATTR.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            name += f" {m[1].lower()}={_DIGITS.sub('', value)}"
            for token in value.split():
                found = _WORD.findall(token)
                if LAYOUT_WORDS.isdisjoint(found):
                    words.update(found)
        if words & COMMENT_WORDS:
            noise = HARD
        elif words & NOISE_WORDS and not (inside_main and words & NOISE_WORDS == {"header"}):
            noise = max(noise, SOFT)
        if _HIDDEN.search(attrs):
            noise = HARD
    return name, noise


def read_page(html: str) -> Page:
    """Blocks of a page in page order, and how its elements are nested."""
    blocks: list[Block] = []
    children: dict[int, list[int]] = {}
    # tag, path, chain of paths, noise, length of the article's chain, in a link
    stack: list[tuple] = [("", 0, (), CLEAR, 0, False)]
    parts: list[str] = []
    linked = 0
    place = stack[0]

    def end_block():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, place[1], place[2], place[3], place[4], linked))
            parts.clear()
        linked = 0

    def add(text: str):
        nonlocal place, linked
        top = stack[-1]
        if not parts:
            place = top
        parts.append(text)
        if top[5]:
            linked += len(text)

    def pop_to(n: int):
        if any(e[0] not in INLINE for e in stack[n:]):
            end_block()
        del stack[n:]

    at, size = 0, len(html)
    find = _TAG.search
    while at < size:
        m = find(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if tag in INLINE:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == tag:
                        pop_to(n)
                        break
                    if stack[n][0] not in INLINE:
                        break
            elif tag not in VOID:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == tag:
                        pop_to(n)
                        break
            continue
        attrs = m[3] or m[6] or ""
        if tag in VOID:
            if tag in BREAKS:
                if parts:
                    parts.append(" ")
            elif tag == "hr":
                end_block()
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else size
            continue
        if tag in ENDS_P:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == "p":
                    pop_to(n)
                    break
                if stack[n][0] not in INLINE:
                    break
            for sibling in SIBLINGS.get(tag, ()):
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == sibling:
                        pop_to(n)
                        break
                    if stack[n][0] in SCOPE:
                        break
        top = stack[-1]
        if tag in INLINE:
            noise = top[3]
            if attrs and not noise:
                noise = _declared(tag, attrs, top[4])[1]
                noise = noise if noise == HARD else CLEAR
            if noise != top[3]:
                end_block()
            stack.append((tag, top[1], top[2], noise, top[4], top[5] or tag == "a"))
            continue
        end_block()
        name, noise = _declared(tag, attrs, top[4])
        if tag == "body" and top[0] == "head":
            stack.pop()
            top = stack[-1]
        main, above = top[4], top[3]
        declares = tag in MAIN_TAGS and noise == CLEAR
        if declares and above == SOFT:
            above = CLEAR if tag == "main" else WRAPPED  # a page has one main; an article may be a teaser
        if len(top[2]) < MAX_DEPTH:
            path = _path(top[1], name)
            chain = (*top[2], path)
            seen = children.setdefault(top[1], [])
            if not seen or seen[-1] != path:
                seen.append(path)
            children.setdefault(path, [])
        else:
            path, chain = top[1], top[2]
        if declares and above == CLEAR and not main:
            main = len(chain)
        stack.append((tag, path, chain, max(noise, above), main, False))
    end_block()
    return Page(blocks, children)
