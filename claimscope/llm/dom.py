"""A tolerant HTML reader that lays out whole batches of pages as arrays of DOM nodes."""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>",
    re.S,
)
TAG_AT = re.compile("</?[a-zA-Z]")
LOOSE = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*)>")
HINTS = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MAY_HIDE = re.compile("hidden|style", re.I)
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)

#: After so many tags whose quotes never end, the rest of a page is read without regard to quotes, so that the cost of
#: a page stays proportional to its length.
MAX_OPEN_QUOTES = 16

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())  # end at their end tag only
UNSEEN = frozenset("template svg select button object audio video canvas head".split())
IN_HEAD = RAW | frozenset("base link meta template basefont bgsound head".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag on the left ends an open element on the right, unless one of the third stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


@dataclass
class Page:
    """Nodes in page order; node 0 is the page.  A leaf has tag ``#text``."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    hints: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])  # characters inside links
    truth: list[int] = field(default_factory=lambda: [-1])  # label of pages made for training
    depth: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, hints: str = "", text: str = "", linked: int = 0, truth: int = -1) -> int:
        """Appends a node and returns its number."""
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.text.append(text)
        self.linked.append(linked)
        self.truth.append(truth)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def parse(html: str) -> Page:
    """Blocks and text leaves of a page.

    Text between two block bounds is one leaf, whatever inline markup it has.  Scripts, styles, form controls,
    comments and hidden elements give no leaf.  Unclosed and stray tags are accepted as browsers do; a hidden element
    ends where a visible one would.  Time is proportional to the page's length, however broken its markup.
    """
    page = Page()
    # open elements with their block's node; one ended out of turn keeps its place, without a name, until it is on top
    stack: list[list] = [["#page", 0]]
    places: dict[str, list[int]] = {}  # of each name, its open elements' places on the stack
    walls: list[int] = [0]  # places of blocks, which inline end tags do not pass
    marks: list[int] = []  # places of hidden elements on the stack; without any, text is seen
    buffer: list[str] = []
    links = linked = at = open_quotes = 0
    size = len(html)
    gt = html.find(">")  # the next one; without any, a "<" is text

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                page.add(stack[-1][1], "#text", text=text, linked=min(linked, len(text)))
            buffer.clear()
        linked = 0

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            walls.append(len(stack))
        stack.append([tag, node])

    def last(tag: str) -> int:
        """Place of the topmost open element of this name, or 0."""
        at = places.get(tag)
        return at[-1] if at else 0

    def forget(d: int) -> None:
        nonlocal links
        name = stack[d][0]
        if name:
            places[name].pop()
            if name == "a":
                links -= 1
            if walls[-1] == d:
                walls.pop()
            stack[d][0] = ""

    def tidy(depth: int) -> None:
        """Takes all from ``depth`` on off the stack, and elements below that have ended."""
        while len(stack) > depth or not stack[-1][0]:
            forget(len(stack) - 1)
            stack.pop()

    def close_to(depth: int) -> None:
        if not marks or depth < marks[0]:
            flush()
        tidy(depth)
        while marks and marks[-1] >= depth:
            marks.pop()

    def end_inline(tag: str) -> None:
        """Ends the topmost inline element of a name unless a block stands between, with all in it if that holds a
        hidden one."""
        d = last(tag)
        if d <= walls[-1]:
            return
        if marks and marks[-1] > d:
            tidy(d)
        else:
            forget(d)
            tidy(len(stack))
        while marks and marks[-1] >= d:
            marks.pop()

    def seen(text: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and not text.isspace():  # text ends a head
            close_to(len(stack) - 1)
        if not marks:
            buffer.append(text)
            if links:
                linked += len(text)

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            seen(html[at:lt])
        if lt >= size:
            break
        if 0 <= gt < lt:
            gt = html.find(">", lt)
        m = None
        if gt >= 0 or html.startswith("<!--", lt):
            m = TOKEN.match(html, lt) if open_quotes < MAX_OPEN_QUOTES or not TAG_AT.match(html, lt) else None
            if m is None:
                m = LOOSE.match(html, lt)
                open_quotes += m is not None
        if m is None:
            if not marks:
                buffer.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        tag = m["tag"] if "tag" in m.re.groupindex else None
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in INLINE:
                end_inline(tag)
                if tag == "br" and not marks:
                    buffer.append(" ")
                continue
            if last(tag):
                close_to(last(tag))
            elif tag == "p" and not marks:
                flush()
            continue
        attrs = m["attrs"]
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close_to(len(stack) - 1)
        if tag in RAW and not (marks and last("svg")):
            if not marks:
                if tag not in ("script", "style", "noscript"):
                    flush()
                buffer.append(" ")
            at = _skip(html, at, tag)
            continue
        hides = tag in UNSEEN or bool(attrs) and _hides(attrs)
        if attrs.endswith("/") and (tag in MATH or tag == "svg" or hides and tag not in UNSEEN) or hides and tag in VOID:
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                if tag == "br" and not marks:
                    buffer.append(" ")
                continue
            if tag == "a":
                end_inline("a")  # a link does not hold another
                links += 1
            if not marks and (hides or tag in ("mtr", "mtd")):
                buffer.append(" ")
            if hides:
                marks.append(len(stack))
            push(tag, stack[-1][1])
            continue
        if tag in VOID:
            if tag == "hr" and not marks:
                flush()
            continue
        if not marks and tag not in ("svg", "button", "select"):
            flush()
        if tag in CLOSES_P and stack[walls[-1]][0] == "p":
            close_to(walls[-1])
        if tag in IMPLIED:
            ends, wall = IMPLIED[tag]
            low = max(last(name) for name in wall)
            open_ones = [places[name] for name in ends if last(name) > low]
            if open_ones and tag == "tr":  # ends a cell and its row
                close_to(min(at[bisect(at, low)] for at in open_ones))
            elif open_ones:
                close_to(max(at[-1] for at in open_ones))
        if tag in ("html", "body") and last(tag):
            continue
        if hides:
            if not marks:
                buffer.append(" ")
            marks.append(len(stack))
        if marks:
            push(tag, stack[-1][1])
            continue
        flush()
        hints = " ".join(x for g in HINTS.findall(attrs) for x in g if x) if attrs else ""
        label = re.search(r"data-content=\"([01])\"", attrs) if "data-content" in attrs else None
        push(tag, page.add(stack[-1][1], tag, hints=hints.lower(), truth=int(label[1]) if label else -1))
    flush()
    return page


def _hides(attrs: str) -> bool:
    """Do the attributes of a start tag hide its element?  Names and values count, not words inside other values."""
    if not MAY_HIDE.search(attrs):
        return False
    own: dict[str, str] = {}
    for name, *values in ATTR.findall(attrs):
        own.setdefault(name.lower(), unescape("".join(values)))
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true":
        return True
    shown = DISPLAY.findall(own.get("style", ""))
    return bool(shown) and shown[-1].lower() == "none"


def _skip(html: str, at: int, tag: str) -> int:
    """Position after the end tag of an element whose content is not markup; its start tag ends at ``at``."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
    gt = html.find(">", m.end()) if m else -1
    return gt + 1 if gt >= 0 else len(html)
