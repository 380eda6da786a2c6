"""Main text of HTML pages by tree scoring.

A page is read once into a small tree: elements with their parent, and runs of text. Scripts,
styles and other raw text are skipped; elements that are boilerplate by tag, role, or a word of
their class or id are dropped with all they hold (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments).

A name that says how a page is laid out (``has-sidebar``, ``comments-open``) marks nothing. Other names can
still stand on a wrapper of the article. A marked element stays if its marks are only words of layout
(``header``, ``sidebar``), its text outside links has at least the points of all unmarked text, and it holds an h1, a
main or an unmarked article element outside further marks; or, whatever its words of layout, if it has four times these
points and hardly any unmarked text is left, unless an unmarked article or main with text stands outside it (the
strongest one first; what it holds then counts as unmarked). Elements marked as comments, adverts, navigation, notices
and the like stay only where the page has no other text. Marked paragraphs are dropped like other elements, marked
headings where the mark is more than a word of layout. A header element inside the article is a header too
and goes with all it holds, a heading included.

Scoring: each block of text (a paragraph, list item, heading, cell, or the loose text of a
container) gets one point, one for each comma, and one for each 100 characters up to three. The
points go in full to its parent, halved to the grandparent, then divided by three, four and so
on. A container's score is multiplied by the share of its text outside links. The best container
gives way to an article or main element in it that has half its score, and is widened to the one
around it, if there is one. Of its siblings those stay
that score at least a fifth of it, or that are prose (paragraphs, headings, lists, tables) with
hardly any links. All blocks of the kept elements are returned in page order.

Where no block scores (all are empty) the text is empty. Reading is a single pass with an
explicit stack, so depth and length of a page do not matter; unclosed tags and comments run to the
end of the page, as in browsers. A quote opens a string only where an attribute's value starts; one
that is never closed is an ordinary character, and its tag ends at the next ``>``.

Defined results: null html is empty; rows are independent, so repeated rows and null ids need no
rule; an empty table gives an empty result; only the key, url and html columns are looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label "
                   "mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav header footer aside form button select option textarea input fieldset script "
                    "style noscript template svg math canvas object embed applet iframe audio video map "
                    "dialog menu title".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table "
                     "ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body td th blockquote".split())
CONTENT = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
# Words of a class or id that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
                  "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar "
                  "footer sidebar aside widget widgets related recommended notice notices cookie cookies "
                  "consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
                  "share sharing social comment comments commentlist disqus replies respond toolbar skip "
                  "copyright disclaimer".split())
# Those that also name wrappers of whole pages.
LAYOUT = frozenset("banner header masthead topbar footer sidebar aside widget widgets toolbar".split())
# Words that turn a name into a remark about the layout.
REMARKS = frozenset("no has have with without open closed off on enabled disabled".split())
LITTLE = 200  # characters outside links and marked elements that are no article
CLEARLY = 4  # times the points of the unmarked text
KEEP_MARKED = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
                  "toolbar form".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# An attribute as browsers read it: a quote opens a string only where a value starts, and only if it is closed.
_PAIR = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_VALUE = re.compile(_PAIR)
_ATTR = re.compile(rf"(?:[\s/]++|{_PAIR})*+>")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z0-9])")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "dropped", "block", "score", "length", "linked", "link", "mark", "outer", "proof",
                 "layout", "content")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, marked: bool = False, layout: bool = True):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.outer = parent.mark if parent is not None else None  # the nearest marked element around this one
        self.mark, self.proof = self if marked else self.outer, False
        self.layout = layout  # no mark but words of layout
        self.content = tag in CONTENT or (parent is not None and parent.content)
        self.block = tag not in INLINE
        self.link = tag == "a" or (parent is not None and parent.link)
        self.score, self.length, self.linked = 0.0, 0, 0


def _marks(value: str) -> set[str]:
    """Words of a class or id that mark boilerplate; names that only remark on the layout give none."""
    found: set[str] = set()
    for name in value.split():
        words = {x.lower() for x in _SPLIT.split(name)}
        if REMARKS.isdisjoint(words):
            found |= words & MARKS
    return found


def _boilerplate(tag: str, attrs: str) -> tuple[bool, set[str]]:
    """Whether an element is dropped in any case, and the words by which its class or id marks it."""
    marks: set[str] = set()
    if tag in DROPPED:
        return True, marks
    if "=" not in attrs and "hidden" not in attrs:
        return False, marks
    for name, value in _VALUE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            marks |= _marks(value)
            continue
        value = value.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, marks
        if name == "role" and value in ROLES:
            return True, marks
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, marks
    return False, marks


def _closing(tag: str) -> tuple[str, ...]:
    return ("p",) if tag in CLOSES_P else SELF_CLOSING.get(tag, ())


def _read(page: str) -> list[tuple[_Node, list[tuple[str, bool, _Node | None]]]]:
    """(element, pieces) of all text blocks in page order; a piece is text, whether in a link, and its mark."""
    root = _Node("html", None, False)
    stack, out, run, owner = [root], [], [], root
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal run
        if run:
            out.append((owner, run))
            run = []

    def pop_to(at: int) -> None:
        nonlocal owner
        if any(x.block for x in stack[at:]):
            flush()
        del stack[at:]
        owner = next(x for x in reversed(stack) if x.block)

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos and not stack[-1].dropped:
            run.append((page[pos:lt], stack[-1].link, stack[-1].mark))
        if lt == n:
            break
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                pos = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                pos = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, lt + (2 if nxt == "/" else 1))
        if name is None:
            if nxt == "/":
                end = page.find(">", lt)
                pos = n if end < 0 else end + 1
            else:
                if not stack[-1].dropped:
                    run.append(("<", stack[-1].link, stack[-1].mark))
                pos = lt + 1
            continue
        tail = _ATTR.match(page, name.end())
        tag, pos = name.group().lower(), n if tail is None else tail.end()
        if tail is None:
            break
        if nxt == "/":
            if tag == "p" or tag not in VOID:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at].tag == tag:
                        pop_to(at)
                        break
                    if tag not in SCOPE and stack[at].tag in SCOPE:
                        break
            continue
        closes = _closing(tag)
        if closes:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in closes:
                    pop_to(at)
                    break
                if stack[at].tag in SCOPE:
                    break
        attrs = tail.group()[:-1]
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not stack[-1].dropped:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    run.append((" ", False, stack[-1].mark))
            continue
        gone, marks = _boilerplate(tag, attrs)
        layout = marks <= LAYOUT
        marked = bool(marks) and tag not in KEEP_MARKED and not (layout and tag in HEADINGS)
        node = _Node(tag, stack[-1], stack[-1].dropped or gone, marked, layout)
        if not node.dropped and not marked and (tag in ("h1", "main") or (tag == "article" and not marks)):
            around = node.outer
            while around is not None and around.layout and not around.proof:
                around.proof, around = True, around.outer
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            if end is None:
                pos = n
            else:
                close = page.find(">", end.start())
                pos = n if close < 0 else close + 1
            continue
        if attrs.endswith("/") and tag not in INLINE and tag not in CLOSES_P and tag not in SCOPE:
            continue
        if node.block:
            flush()
            owner = node
        stack.append(node)
    flush()
    return out


def _rendered(read: list, shut: Callable[[_Node | None], bool]) -> list[tuple[_Node, str, int, _Node | None]]:
    """(element, text, characters in links, mark) of the blocks, without the pieces under a mark that is ``shut``."""
    out = []
    for owner, pieces in read:
        run = [x for x in pieces if not shut(x[2])]
        text = _SPACE.sub(" ", entities.unescape("".join(t for t, _, _ in run))).strip()
        if text:
            out.append((owner, text, min(sum(len(t) for t, link, _ in run if link), len(text)), run[0][2]))
    return out


def _points(text: str) -> float:
    return 1.0 + text.count(",") + min(len(text) // 100, 3)


def _wrappers(read: list) -> set[_Node]:
    """Marked elements that hold the article, and so stay."""
    marks: dict[_Node, list[float]] = {}  # mark: points and characters outside links, of its own pieces only
    bare, content = [0.0, 0.0], False
    for owner, text, linked, mark in _rendered(read, lambda _: False):
        own = bare if mark is None else marks.setdefault(mark, [0.0, 0.0])
        own[0] += _points(text) * (1.0 - linked / len(text))
        own[1] += len(text) - linked
        content = content or (mark is None and owner.content and len(text) > linked)
    total: dict[_Node, float] = {}
    for mark, (points, _) in marks.items():
        around = mark
        while around is not None:
            total[around] = total.get(around, 0.0) + points
            around = around.outer

    def fits(x: _Node) -> bool:
        if total[x] <= 0:
            return False
        if not x.layout:
            return not bare[1]
        if x.proof:
            return total[x] >= bare[0]
        return total[x] >= bare[0] * CLEARLY and bare[1] < LITTLE and (not content or x.content)

    stay: set[_Node] = set()
    while True:
        fit = [x for x in total if x not in stay and (x.outer is None or x.outer in stay) and fits(x)]
        if not fit:
            return stay
        best = max(fit, key=lambda x: (x.layout, x.proof, total[x]))
        stay.add(best)
        own = marks.get(best, (0.0, 0.0))
        bare = [bare[0] + own[0], bare[1] + own[1]]


def blocks(page: str) -> list[tuple[_Node, str, int]]:
    """(element, text, characters in links) of all text blocks in page order, outside boilerplate."""
    read = _read(page)
    if all(mark is None for _, pieces in read for _, _, mark in pieces):
        return [x[:3] for x in _rendered(read, lambda _: False)]
    stay = _wrappers(read)
    known: dict[_Node | None, bool] = {None: False}

    def shut(mark: _Node | None) -> bool:
        path = []
        while mark not in known and mark in stay:
            path.append(mark)
            mark = mark.outer
        answer = known.setdefault(mark, True)
        known.update(dict.fromkeys(path, answer))
        return answer

    return [x[:3] for x in _rendered(read, shut)]


def _score(found: list[tuple[_Node, str, int]]) -> dict[_Node, float]:
    """Points of every container: score times the share of its text outside links."""
    nodes: dict[_Node, None] = {}
    for block, text, linked in found:
        points = _points(text)
        loose = block.tag in SCOPE or block.tag == "html"
        level, node = 0 if loose else -1, block
        while node is not None:
            nodes[node] = None
            node.length += len(text)
            node.linked += linked
            if level >= 0:
                node.score += points / (1, 2, 3)[level] if level < 3 else points / (level + 1)
            level, node = level + 1, node.parent
    return {x: x.score * (1.0 - x.linked / x.length) for x in nodes}


def _inside(node: _Node, other: _Node) -> bool:
    while node is not None and node is not other:
        node = node.parent
    return node is not None


def main_text(page: str | None) -> str:
    """Blocks of the article joined by an empty line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    score = _score(found)
    best = max(score, key=score.__getitem__)  # of equal ones the first in page order
    inner = [x for x in score if x.tag in CONTENT and score[x] * 2 >= score[best] and _inside(x, best)]
    if inner:
        best = max(inner, key=score.__getitem__)
    around = best
    while around is not None:
        if around.tag in CONTENT:
            best = around
        around = around.parent
    limit = max(score[best] / 5, 1e-9)
    kept = {best}
    for x in score:
        if x.parent is best.parent and x is not best and best.parent is not None and best.tag not in CONTENT:
            density = x.linked / x.length
            text_like = x.tag in PROSE and density < 0.25
            if text_like or (score[x] >= limit and density < 0.5):
                kept.add(x)
    inside: dict[_Node, bool] = {}

    def within(node: _Node) -> bool:
        path = []
        while node is not None and node not in inside and node not in kept:
            path.append(node)
            node = node.parent
        answer = node is not None and (node in kept or inside[node])
        for x in path:
            inside[x] = answer
        return answer

    return "\n\n".join(text for block, text, _ in found if within(block))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, ``text`` and ``n_chars`` per input row."""
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    udf = F.arrow_udf(texts, "string")
    return (df.select(F.col(key), F.col(url), udf(F.col(page)).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))

