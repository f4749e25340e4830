"""Operator 10: main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less with each level; a container's points are
discounted by link density and weighed by its tag and names; the best container and the siblings that read like it are
kept. A name of a class or id is a doubt and never a proof: what it names is left out only if the name says nothing
else and a second sign agrees (links, form controls, names within, or a small share of the page's text).
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table, with_columns

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg object canvas".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP = frozenset("nav footer aside form button dialog menu head input fieldset select".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPH = _HEADING | frozenset("p pre td blockquote li dd figcaption".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: The open element that a start tag ends, and the elements that keep it open.
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_P_SCOPE = ("article", "body", "button", "td", "th", "table", "main", "section", "div", "blockquote", "li")
# an attribute's value is quoted only if the quote follows the equals sign
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)|</[^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAME = re.compile(r"[a-z]+")
#: Words of class and id names that speak against an element, those that speak for it, and first words
#: that say nothing of the element itself.
_AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer foot comment comments commentlist disqus reply replies respond cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget pagination pager tags tagcloud toolbar skip search".split()
)
_FOR = frozenset("article content entry main post story text body hentry".split())
_OF_OTHERS = frozenset("no not has have with without hide show is".split())
#: Words that say no more of an element than its shape or place; a name of these and of words against it is a whole one.
_SHAPES = frozenset(
    "area bar block bottom box btn button buttons card center column container content div element footer form global group header holder icons inner inline item items left link links list main module "
    "outer page panel placeholder post posts primary region right row secondary section site slot sticky thread top unit wrap wrapper x y".split()
)
_CONTROLS = frozenset("input button textarea select form".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Weights of the score: the share that each level passes on; articles and mains; elements with names for and against
#: them; what is left out; the share of the best score that a sibling needs; link density of a menu and of what a name
#: doubts; the share of the page's unlinked text that is much.
PASSED, ARTICLE, NAMED, UNNAMED, DOUBTED, SIBLING, MENU, LINKED, MUCH = 0.8, 1.6, 1.25, 0.9, 0.1, 0.2, 0.8, 0.3, 1 / 3
#: Doubts: a word within a longer name, a whole id, a whole class.
NONE, WORD, ID, CLASS = 0, 1, 2, 3
#: Characters of a link beyond which a list of links in an article reads as references, on average.
REFERENCE = 25

class _Node:
    __slots__ = ("tag", "parent", "block", "open", "items", "points", "away", "weight", "trust", "size", "linked", "links", "doubt", "inside", "controls", "doubted", "around", "within", "titled")

    def __init__(self, tag: str, parent: "_Node | None", away: bool, weight: float, doubt: int = NONE, inside: bool = False):
        self.tag, self.parent, self.items, self.points, self.away, self.weight = tag, parent, [], 0.0, away, weight
        self.doubt, self.inside, self.around, self.within, self.titled = doubt, inside, None, 0, 0
        self.size = self.linked = self.links = self.controls = self.doubted = 0
        self.trust = 1.0
        # inline elements that are open are counted by the block that they are in
        self.block = parent.block if tag in _INLINE else self
        self.open: dict[str, int] = {}


def _marks(tag: str, attrs: str, inside: bool) -> tuple[bool, float, int]:
    """Whether an element can be no part of an article, the weight of its score, and what its names say against it. inside: of an article or main."""
    away = tag in _DROP or (tag == "header" and not inside)
    weight = ARTICLE if tag in ("article", "main") else 1.0
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return away, weight, NONE
    good, doubt = False, NONE
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for token in value.split():
                words = _NAME.findall(token)
                if words and words[0] not in _OF_OTHERS:
                    against = _AGAINST.intersection(words)
                    good = good or not _FOR.isdisjoint(words)
                    if against and not (inside and "header" in words):
                        whole = all(w in against or w in _SHAPES for w in words)
                        doubt = max(doubt, (CLASS if name == "class" else ID) if whole else WORD)
        elif name == "role":
            away = away or value in _AWAY_ROLES
            weight = max(weight, ARTICLE if value in ("main", "article") else 1.0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            away = True
    # names that contradict each other say nothing, and no name speaks against an article
    if good or tag in ("article", "main"):
        if good and not doubt:
            weight = max(weight, NAMED)
        return away, weight, NONE
    return away, weight * (UNNAMED if doubt else 1.0), doubt


def parse(page: str) -> _Node:
    """A lenient tree in time linear in the page: unclosed paragraphs, items and cells end as in browsers; a stray end tag is ignored."""
    root = node = _Node("#root", None, False, 1.0)
    at, n, inside = 0, len(page), 0
    open_: dict[str, int] = {}
    lower = None

    def close(to: _Node) -> _Node:
        """Ends the open elements up to `to`; the one that is then current."""
        nonlocal inside
        y = node
        while True:
            open_[y.tag] -= 1
            inside -= y.tag in ("article", "main")
            if y.block is not y:
                y.block.open[y.tag] -= 1
            if y is to:
                return to.parent
            y = y.parent

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            node.items.append(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if lt > at:
            node.items.append(page[at:lt])
        if m is None:
            node.items.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.items.append(_Node("br", node, False, 1.0))
            elif tag in _INLINE and node.block.open.get(tag, 0) or tag not in _INLINE and open_.get(tag, 0):  # an inline end tag doesn't close a block
                x = node
                while x.tag != tag:
                    x = x.parent
                node = close(x)
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                lower = lower if lower is not None else page.lower()
                if len(lower) != n:
                    end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                    stop = end.start() if end else -1
                else:
                    stop = lower.find(f"</{tag}", at)
                if stop < 0:
                    if tag in ("script", "style", "textarea", "title", "template"):
                        break
                    continue
                gt = page.find(">", stop)
                at = n if gt < 0 else gt + 1
            continue
        if tag in _CLOSES_P or tag in _SAME:
            same, scope = (_SAME[tag], _SCOPE[tag]) if tag in _SAME else (("p",), _P_SCOPE)
            if any(open_.get(t, 0) for t in same):
                x = node.block
                while x.parent is not None and x.tag not in scope and x.tag not in same:
                    x = x.parent.block
                if x.tag in same:
                    node = close(x)
        child = _Node(tag, node, *_marks(tag, m[3], inside > 0), inside > 0)
        node.items.append(child)
        if tag not in _VOID:
            if child.block is not child:
                child.block.open[tag] = child.block.open.get(tag, 0) + 1
            open_[tag] = open_.get(tag, 0) + 1
            node = child
            inside += tag in ("article", "main")
    return root


def _summed(order: list[_Node]) -> None:
    """By node the sizes of all and of linked text, links, form controls and whole class names that doubt: without what lies in away nodes below."""
    for x in order:
        x.size = x.linked = x.links = x.controls = x.doubted = x.titled = 0
    for x in reversed(order):
        x.size += sum(len(y) - y.count(" ") // 2 for y in x.items if isinstance(y, str) and not y.isspace())
        if x.tag == "a":
            x.linked, x.links = x.size, 1
        if x.tag in _HEADING:
            x.titled = x.size - x.linked
        if x.parent is not None:
            x.parent.controls += x.controls + (x.tag in _CONTROLS)
            x.parent.doubted += x.doubted + (x.doubt == CLASS)
            if not x.away:
                x.parent.size += x.size
                x.parent.linked += x.linked
                x.parent.links += x.links
                x.parent.titled += x.titled


def _left_out(x: _Node, total: int, elsewhere: int) -> bool:
    """Whether what the names of an element say against it is borne out. total: unlinked text of the page; elsewhere: that of the article around or beside it, without its titles.

    A word within a name needs a sign: links, form controls, or whole names within. A whole name needs none, unless it
    is an id over a heading, as sections of articles have, or unless it holds much of the page and no other article is there.
    """
    if x.doubt == WORD or (x.doubt == ID and x.titled):
        return (_density(x) > LINKED or x.controls > 0 or x.doubted > 0) and x.size - x.linked < MUCH * total
    return x.size - x.linked < MUCH * total or (elsewhere > 0 and not x.within)


def _measure(root: _Node) -> list[_Node]:
    """All nodes, outer ones first, with their sizes, after the doubts were settled."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(y for y in x.items if isinstance(y, _Node))
    _summed(order)
    doubts = [x for x in order if x.doubt and not x.away]
    if doubts:
        total = root.size - root.linked
        for x in order:  # the nearest article around
            if x.parent is not None:
                x.around = x.parent if x.parent.weight > 1 else x.parent.around
        for x in reversed(order):  # the text of articles within
            if x.weight > 1 and not x.doubt:
                x.within = x.size - x.linked
            if x.parent is not None and not x.away:
                x.parent.within += x.within
        settled = []
        for x in doubts:
            plain = lambda y: y.size - y.linked - y.titled
            settled.append(_left_out(x, total, plain(x.around) - plain(x) if x.around is not None else root.within - x.within))
        for x, away in zip(doubts, settled, strict=True):
            x.away = away
        _summed(order)
    for x in order:
        if x.parent is not None:
            x.trust = x.parent.trust * (DOUBTED if x.away else 1.0)
    return order


def _own_text(x: _Node) -> str:
    """Text of a node without what lies in blocks below it."""
    out, stack = [], [iter(x.items)]
    while stack:
        for y in stack[-1]:
            if isinstance(y, str):
                out.append(y)
            elif not y.away and y.tag in _INLINE:
                stack.append(iter(y.items))
                break
        else:
            stack.pop()
    return "".join(out)


def _density(x: _Node) -> float:
    return x.linked / x.size if x.size else 0.0


def _score(order: list[_Node]) -> dict[int, tuple[float, _Node]]:
    """The score of each container: the points of its paragraphs by level, without its share of links, by its weight."""
    for x in order:
        if x.tag in _INLINE or x.tag == "br":
            continue
        own = _own_text(x)
        size = len(own.strip())
        if not size or (x.tag not in _PARAGRAPH and size < 25):
            continue
        points = (1 + min(size / 100, 3) + own.count(",") + own.count("，")) * (1 - _density(x)) * x.trust
        (x.parent if x.tag in _PARAGRAPH else x).block.points += points
    # inner ones first: what a container has, its own paragraphs and what came from below, goes up by a share
    for x in reversed(order):
        if x.points and x.parent is not None and x.block is x:
            x.parent.block.points += x.points * PASSED
    return {id(x): (x.points * (1 - _density(x)) * x.weight, x) for x in order if x.points}


def _texts(x: _Node) -> str:
    """Text below a node: blocks and line breaks part it, inline elements don't; character references are decoded; away nodes and menus are left out."""
    out, stack = [], [iter((x,))]
    while stack:
        for y in stack[-1]:
            if isinstance(y, str):
                out.append(entities.unescape(y) if "&" in y else y)
            elif y is x or not (y.away or _menu(y)):
                if y.tag not in _INLINE:
                    out.append(" ")
                    stack.append(iter((*y.items, " ")))
                else:
                    stack.append(iter(y.items))
                break
        else:
            stack.pop()
    return " ".join("".join(out).split())


def _menu(x: _Node) -> bool:
    """A list of links and nothing else; in an article only if its links are short and no heading stands right before it."""
    if not (x.tag in ("ul", "ol", "div", "table") and x.links >= 3 and _density(x) > MENU):
        return False
    if not x.inside or x.parent is None:
        return True
    before = None
    for y in x.parent.items:
        if y is x:
            break
        if isinstance(y, _Node) and y.tag not in ("br", "hr") or isinstance(y, str) and not y.isspace():
            before = y
    return x.linked < REFERENCE * x.links and not (isinstance(before, _Node) and before.tag in _HEADING)


def _reads_on(x: _Node, scores: dict[int, tuple[float, _Node]], top: float, weight: float) -> bool:
    """Whether a sibling of the best container, which has that score and weight, belongs to the article."""
    if x.away or _menu(x):
        return False
    if x.tag in _HEADING or (x.weight >= weight and scores.get(id(x), (0.0, x))[0] >= SIBLING * top):
        return True
    if x.tag in ("p", "blockquote", "pre", "figure", "ul", "ol", "dl", "table"):
        return _density(x) < 0.25 if x.size > 80 else x.linked == 0 and x.size > 0
    return False


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; "" for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    scores = _score(order)
    if not scores:
        return _texts(root)
    top, best = max(scores.values(), key=lambda s: s[0])
    if best.tag in ("html", "body", "#root"):
        return _texts(best)
    weight = best.weight
    while True:
        parts = [best]
        around = best.parent
        while around.block is not around:
            around = around.parent
        others = [y for y in around.items if isinstance(y, _Node) and y is not best and y.size and y.tag not in _INLINE]
        near = [y for y in others if _reads_on(y, scores, top, weight)]
        if around.tag not in ("html", "body", "#root") and len(near) == sum(not y.away and not _menu(y) for y in others):
            best = around  # nothing but the article is in it
            continue
        if near:
            kept = {id(best), *map(id, near)}
            parts = [y for y in around.items if id(y) in kept]
        return " ".join(t for t in map(_texts, parts) if t)


def extract(df: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """df with the main text of each row's page. Null and empty pages give ""; other columns pass through, one of this name is replaced."""
    return with_columns(df, html, lambda: lambda pages: [[main_text(x) for x in pages]], f"{out} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
