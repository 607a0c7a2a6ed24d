"""Blocks of text of a page, each with the part of the page that it stands in. Plain Python, one page at a time.

The page is read once, tag by tag, in time linear in its length. Scripts, styles, comments and the like are skipped whole,
also where they never end. Block elements end a block; all other tags leave the text as it runs, and ``br`` counts as white space.
"""

from __future__ import annotations

import html
import re

#: Parts of a page. FRAME: menus, headers, footers, sidebars, notices, adverts, forms, comments. MAIN: in the page's article.
FRAME, OPEN, MAIN = 0, 1, 2

#: Text of these is no text of the page.
SKIPPED = (
    "script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "canvas", "audio", "video",
    "xmp", "noframes", "noembed", "select", "button", "datalist",
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one that stands directly before it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Elements that frame a page, whatever stands in them; headers and footers of an article are below.
FRAMES = frozenset("nav aside form menu dialog search label legend fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that mark the same.
FRAME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar masthead topbar header footer colophon copyright "
    "sidebar aside widget widgets related recommended recommendations trending promo promos promotion ad ads adv advert adverts advertisement "
    "advertising adsbygoogle sponsor sponsored sponsors banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "paywall newsletter subscribe subscription signup login share sharing social follow skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words of class and id that mark the article where no element does.
MAIN_WORDS = frozenset("article content main post entry story maincontent".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<skipped>" + "|".join(SKIPPED) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=skipped)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+>|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _kind(name: str, rest: str) -> str:
    """What an element marks: 'frame', 'comment', 'main', 'weak' (main by its class), 'part' (a header or footer) or ''."""
    words, whole = set(), []
    if "=" in rest or "hidden" in rest:
        for key, *values in _MARKS.findall(rest):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "role" and value.lower() in ROLES:
                return "frame"
            if key == "role" and value.lower() in ("main", "article"):
                return "main"
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return "frame"
            if key in ("class", "id"):
                whole += [v.lower() for v in value.split()]
                words |= {w.lower() for w in _WORDS.findall(value)}
    if name not in ("html", "body") and words & COMMENT_WORDS:
        return "comment"
    if name in ("article", "main"):
        return "main"
    if name in FRAMES:
        return "frame"
    if name in ("header", "footer"):
        return name
    if name in ("html", "body") or name in HEADINGS:
        return ""
    if words & MAIN_WORDS and (not words & FRAME_WORDS or words & {"no", "with", "without", "has"}):
        return "weak" if any(w in MAIN_WORDS or set(re.split(r"[-_]", w)) <= MAIN_WORDS | {"body", "text", "page", "site", "area"} for w in whole) else ""
    return "frame" if words & FRAME_WORDS and not words & MAIN_WORDS else ""


class _Reader:
    """Reads one page. Open elements are kept on a stack, those that mark nothing and end no block are not."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int]] = []  # text, part, rank of the mark (2: element, 1: class)
        self.text: list[str] = []
        self.stack: list[tuple[str, tuple]] = []
        self.open: dict[str, int] = {}
        #: (part, rank, hard): hard frames hold no article, soft ones (forms, classes) may be wrapped around it.
        self.state: tuple[int, int, bool] = (OPEN, 0, False)
        self.linked = self.plain = 0
        self.links = 0
        self.at = ""

    def end_block(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                part, rank, _ = self.state
                if part == OPEN and self.linked and not self.plain and self.at in ("li", "td", "div", "ul", "dd", ""):
                    part = FRAME  # nothing but links
                self.blocks.append((text, part, rank))
            self.text = []
        self.linked = self.plain = 0

    def add(self, text: str) -> None:
        if not self.open.get("head"):
            self.text.append(text)
            if not text.isspace():
                if self.links:
                    self.linked += 1
                else:
                    self.plain += 1

    def push(self, name: str, rest: str) -> None:
        if name == "a":
            self.links = 1
            return
        if name in VOID:
            if name == "hr":
                self.end_block()
            elif name == "br":
                self.text.append(" ")
            return
        block = name in BLOCKS
        if block:
            self.end_block()
            top = self.stack[-1][0] if self.stack else ""
            if top == "p" or top in ENDS.get(name, ()):
                self.pop(top)
            if name == "body":
                self.open.pop("head", None)
        kind = _kind(name, rest)
        if not block and not kind:
            return
        if kind and not block:
            self.end_block()
        before = self.state
        part, rank, hard = before
        if kind == "comment":
            self.state = (FRAME, 0, True)
        elif kind == "main" and not (part == FRAME and hard):
            self.state = (MAIN, 2, False)
        elif kind == "weak" and part != FRAME and rank < 2:
            self.state = (MAIN, 1, False)
        elif kind in ("header", "footer"):
            if not (part == MAIN and kind == "header"):
                self.state = (FRAME, 0, kind == "footer")
        elif kind == "frame":
            self.state = (FRAME, 0, name in ("nav", "aside", "menu", "dialog"))
        self.stack.append((name, before))
        self.open[name] = self.open.get(name, 0) + 1
        self.at = name

    def pop(self, name: str) -> None:
        if name == "a":
            self.links = 0
            return
        if name == "p" and not self.open.get("p"):
            self.end_block()
            return
        if not self.open.get(name):
            if name in BLOCKS:
                self.end_block()
            return
        self.end_block()
        while self.stack:
            last, before = self.stack.pop()
            self.open[last] -= 1
            self.state = before
            if last == name:
                break
        self.at = self.stack[-1][0] if self.stack else ""


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, part) of every block of a page, in order; none for null or empty. Only one mark of the article counts: an element
    before a class."""
    if not page:
        return []
    reader, at = _Reader(), 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            reader.add(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name:
            if tag["rest"].endswith(">"):
                (reader.pop if tag["close"] else lambda n: reader.push(n, tag["rest"]))(name.lower())
    if at < len(page):
        reader.add(page[at:])
    reader.end_block()
    best = max((rank for _, part, rank in reader.blocks if part == MAIN), default=0)
    return [(text, part if part != MAIN or rank == best else OPEN) for text, part, rank in reader.blocks]
