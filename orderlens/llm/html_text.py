"""Main text of web pages by shallow text features.

A page becomes a flat list of text blocks, cut at block-level tags.  Each
block has its number of words and its share of words inside links, those of
its two neighbours (other than page furniture), whether it is a heading,
whether the nearest telling container is an article or page furniture, and
whether the page has an article at all.  A decision tree, grown here from
the small labelled table EXAMPLES, says which blocks are main text.

All that stands in an article is its text, also short paragraphs and lists
of links.  On a page without any article, headings and short paragraphs with
text beside them are text too; a list of links there cannot be told from a
menu and goes, with a heading that only it follows.

Defined results: a null or empty html gives an empty text; text outside any
tag is a block; a tag that is never closed ends with the page; repeated rows
each get their own text; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
UNREAD = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr option".split())
CLOSES_P = HEADINGS | frozenset("""address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header
hgroup hr li main menu nav ol p pre search section summary table ul""".split())
#: What the start of an element ends, up to the nearest of the second names; its end tag looks no further either.
ENDED = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu", "dir", "table"))), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl", "table"))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))), "tr": (("td", "th", "tr"), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",))),
}
FURNITURE_NAMES = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent
disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup modal promo promoted related
replies share sharing sidebar skip social sponsor sponsored subscribe tags toolbar widget""".split())
#: Furniture too: names made of furniture words, other than those of LAYOUT, and these; and the whole names below.
FILLERS = frozenset("""area bar block body box button buttons container form group icons inner item items law link links list media panel posts
section slot thread tools unit wrap wrapper""".split())
LAYOUT = frozenset("header masthead sidebar".split())
FURNITURE_COMPOUNDS = frozenset("""article-footer article-sidebar content-footer content-sidebar entry-comments entry-footer entry-tags left-nav main-menu
main-nav main-navigation main-sidebar page-footer page-nav page-navigation post-comments post-footer post-navigation post-tags primary-menu primary-nav
related-articles related-content related-stories right-nav secondary-menu secondary-nav site-footer site-header site-menu site-nav site-navigation
skip-to-content sub-nav top-nav""".split())
#: Names of what holds articles that are not the page's own.
OTHER_ARTICLES = frozenset("comment comments disqus promo promoted related replies sponsor sponsored".split())
ARTICLE_NAMES = frozenset("article content entry main post story".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
                     |<(?P<end>/?)(?P<name>[A-Za-z][^\s/><]*+)(?!<)(?P<attributes>(?:[^<>"']|"[^"<>]*+"|'[^'<>]*+')*+[^>]*+)(?:>|\Z)""", re.S | re.X)
#: Where unread content stops, by element.  Within a head, all but a script also stop where the head does.
OWN_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in UNREAD}
HEAD_END = {name: re.compile(rf"</(?:{name}|head)(?=[\s/>]|\Z)|<body(?=[\s/>]|\Z)", re.I) for name in UNREAD - {"script"}}
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

OUTSIDE, ARTICLE, PAGE_FURNITURE = 0, 1, 2
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "in_article", "in_furniture", "page_has_article")

#: The labelled table: the first seven FEATURES of a block, then 1 or 0 for main text or not when the block stands in no telling
#: container, on a page that has an article elsewhere and on one that has none.  In an article all of them are main text, in
#: page furniture none is.
EXAMPLES = [
    # long and medium paragraphs
    (120, 0, 9, 0, 60, 0, 0, 1, 1), (45, .1, 120, 0, 30, 0, 0, 1, 1), (30, 0, 45, .1, 12, .1, 0, 1, 1), (400, 0, 3, 0, 10, .2, 0, 1, 1),
    (80, 0, 60, 0, 70, 0, 0, 1, 1), (35, 0, 6, 0, 40, 0, 0, 1, 1), (60, .1, 2, 1, 35, 0, 0, 1, 1), (25, .05, 90, 0, 30, 0, 0, 1, 1),
    (18, 0, 50, 0, 22, 0, 0, 1, 1), (12, 0, 45, 0, 60, 0, 0, 1, 1), (200, .2, 4, .5, 5, 1, 0, 1, 1), (40, 0, 80, 0, 3, .7, 0, 1, 1),
    (16, 0, 30, .1, 35, 0, 0, 1, 1), (22, 0, 1, 1, 33, 0, 0, 1, 1), (70, 0, 10, 0, 12, 0, 0, 1, 1), (150, .1, 3, 0, 20, 0, 0, 1, 1),
    (90, 0, 60, 0, 0, 0, 0, 1, 1), (14, .3, 80, 0, 35, 0, 0, 1, 1), (40, 0, 0, 0, 0, 0, 0, 1, 1), (30, 0, 2, 1, 3, 1, 0, 1, 1),
    # headings
    (9, 0, 7, 0, 70, 0, 1, 1, 1), (2, 0, 0, 0, 80, 0, 1, 1, 1), (7, 0, 3, 1, 50, 0, 1, 1, 1), (5, 0, 40, 0, 45, 0, 1, 1, 1),
    (12, 0, 8, 0, 12, 0, 1, 1, 1), (4, 0, 30, 0, 3, 0, 1, 0, 1), (3, 0, 1, 1, 6, 1, 1, 0, 0), (1, 0, 2, 1, 1, 1, 1, 0, 0),
    (2, 0, 0, 0, 1, 0, 1, 0, 1), (1, 0, 2, 0, 2, 0, 1, 0, 1), (2, 0, 3, 1, 2, 0, 1, 0, 1), (3, 0, 60, 0, 2, 1, 1, 0, 0), (2, 0, 8, 0, 3, 1, 1, 0, 0),
    (3, 0, 25, 0, 0, 0, 1, 0, 1),
    # short paragraphs and scraps
    (1, 0, 60, 0, 45, 0, 0, 0, 1), (4, 0, 12, 0, 20, 1, 0, 0, 1), (3, 0, 0, 0, 0, 0, 0, 0, 1), (6, 0, 4, .5, 3, 1, 0, 0, 0),
    (8, .1, 50, 0, 3, 1, 0, 0, 1), (4, 0, 40, 0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 1, 1, 0, 0, 0), (3, 0, 2, 1, 2, 1, 0, 0, 0),
    (8, 0, 1, 1, 10, 0, 0, 0, 1), (2, 0, 8, 0, 9, 0, 0, 0, 1), (7, 0, 8, 0, 8, 0, 0, 0, 1), (2, 0, 2, 0, 2, 0, 0, 0, 1),
    (2, 0, 1, 0, 60, 0, 0, 0, 1), (3, 0, 2, 0, 2, 1, 0, 0, 1), (2, 0, 3, 1, 0, 0, 0, 0, 0), (1, 0, 0, 0, 5, 0, 0, 0, 1), (1, 0, 4, 0, 0, 0, 0, 0, 1),
    # links between paragraphs
    (6, 1, 50, 0, 64, 0, 0, 0, 1), (60, .6, 40, 0, 25, 0, 0, 0, 1), (12, .5, 90, .1, 8, 0, 0, 0, 1), (10, .7, 60, 0, 12, .1, 0, 0, 1),
    (2, 1, 9, 0, 12, 0, 0, 0, 1), (5, 1, 3, 0, 30, 0, 0, 0, 1),
    # lists of links
    (2, 1, 3, 1, 2, 1, 0, 0, 0), (3, 1, 2, 1, 4, 1, 0, 0, 0), (1, 1, 2, 1, 9, 1, 0, 0, 0), (4, 1, 3, 1, 3, 1, 0, 0, 0),
    (25, .8, 5, 1, 20, .9, 0, 0, 0), (5, .9, 2, 1, 4, 1, 0, 0, 0), (50, .9, 10, 1, 40, .8, 0, 0, 0), (1, 1, 1, 1, 1, 1, 0, 0, 0),
    (2, 1, 60, 0, 3, 1, 0, 0, 0), (3, 1, 2, 1, 45, 0, 0, 0, 0), (1, 1, 0, 0, 1, 1, 0, 0, 0), (2, 1, 1, 1, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0, 0, 0, 0),
]


def examples() -> list[tuple]:
    """EXAMPLES in each container: FEATURES and the label."""
    return [(*e[:7], *place) for e in EXAMPLES for place in ((1, 0, 1, 1), (0, 0, 1, e[7]), (0, 0, 0, e[8]), (0, 1, 1, 0), (0, 1, 0, 0))]


DEPTH = 10


def grow(rows: list[tuple], depth: int = DEPTH):
    """A decision tree by Gini impurity: a label, or (feature, limit, tree at or below it, tree above)."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for feature in range(len(rows[0]) - 1):
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            sides = [r[-1] for r in rows if r[feature] <= limit], [r[-1] for r in rows if r[feature] > limit]
            impurity = sum(sum(s) * (len(s) - sum(s)) / len(s) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, limit
    if best is None:
        return int(2 * ones >= len(rows))
    _, feature, limit = best
    return (feature, limit, grow([r for r in rows if r[feature] <= limit], depth - 1), grow([r for r in rows if r[feature] > limit], depth - 1))


@cache
def tree():
    return grow(examples())


def classify(node, features: tuple) -> int:
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def _is_furniture(name: list[str]) -> bool:
    """Whether a whole class name, given as its words, names page furniture."""
    words = {*name}
    return (bool(words) and words <= FURNITURE_NAMES or "-".join(name) in FURNITURE_COMPOUNDS
            or bool(words & FURNITURE_NAMES) and not words & LAYOUT and words <= FURNITURE_NAMES | FILLERS)


def _container(name: str, attributes: str, around: int) -> tuple[int, bool | None]:
    """What the element ``name`` means for the blocks inside it; if it is furniture by itself, whether an article inside it overrides that."""
    if name in ("article", "main") or (name == "body" and around == OUTSIDE):
        named = OUTSIDE if name == "body" else ARTICLE
    elif name in FURNITURE or (name == "header" and around != ARTICLE):
        return PAGE_FURNITURE, False
    else:
        named = around
    names = []
    if name not in ("body", "main") and "=" in attributes:
        names = [[w for w in re.split(r"[^a-z]+", n) if w] for m in NAMES.finditer(attributes) for n in "".join(m.groups("")).lower().split()]
    words = {w for n in names for w in n}
    negated = bool(words & {"with", "has", "no"})
    told = any(ARTICLE_NAMES & {*n} and (negated or name == "article" or not FURNITURE_NAMES & {*n}) for n in names)
    if not negated and not (told and name == "article"):
        kept = LAYOUT - {"sidebar"} if around == ARTICLE else frozenset()           # an article has a header too
        if any(_is_furniture(n) and not kept & {*n} for n in names):
            return PAGE_FURNITURE, name != "article" and not words & OTHER_ARTICLES
    if around == PAGE_FURNITURE:
        return around, None
    return ARTICLE if told else named, None


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, container, heading) of the page's text blocks, in order."""
    found, text, in_links = [], [], []
    # Open elements: name, the place around, the place inside.  A place is [container, whether an article inside overrides it],
    # the same object for all that stands in it, as an article may come after other blocks
    open_: list[tuple[str, list, list]] = []
    counts: Counter[str] = Counter()                # of the names in open_
    state, links, heading, in_head, at = [OUTSIDE, False], 0, 0, False, 0
    endless: set[str] = set()                       # elements without an end tag from here on

    def close_block() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            found.append((" ".join(words), len(words), len(html.unescape("".join(in_links)).split()), state, heading))
        text.clear()
        in_links.clear()

    def read(piece: str) -> None:
        text.append(piece)
        if links:
            in_links.append(piece)

    def leave(names: tuple[str, ...], within: tuple[str, ...] = ()) -> bool:
        """End the innermost open element of ``names`` and all in it, if it is not beyond one of ``within``."""
        nonlocal state
        if any(counts[n] for n in names):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in names:
                    state = open_[i][1]
                    counts.subtract(e[0] for e in open_[i:])
                    del open_[i:]
                    return True
                if open_[i][0] in within:
                    break
        return False

    def enter(name: str, attributes: str) -> None:
        nonlocal state
        around = state
        if name in ("article", "main") and around[0] == PAGE_FURNITURE and _container(name, attributes, OUTSIDE)[0] == ARTICLE:
            furniture = [e for e in open_ if e[1] is not e[2] and e[2][0] == PAGE_FURNITURE]
            if all(e[2][1] for e in furniture):
                for _, before, inside in furniture:
                    inside[0] = before[0]
        container, yields = _container(name, attributes, around[0])
        if container != around[0] or yields is not None:
            state = [container, bool(yields) and not counts["article"]]
        open_.append((name, around, state))
        counts[name] += 1

    while m := TAG.search(page, at):
        if not in_head and m.start() > at:
            read(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if in_head and name == ("head" if m["end"] else "body"):
            in_head = False
        if name in UNREAD:
            if m["end"] or m["attributes"].endswith("/"):
                continue
            close_block()
            if name == "head":
                in_head = True
            elif name not in endless:
                stop = (HEAD_END if in_head else OWN_END).get(name, OWN_END[name]).search(page, at)
                if stop:
                    at = stop.start()
                elif in_head:
                    endless.add(name)
                else:
                    at = len(page)
            continue
        if in_head or not name:
            continue
        if name == "a":
            links = 0 if m["end"] else 1
            in_links.append(" ")
            continue
        if name in INLINE:
            if name in ("br", "img"):
                read(" ")
            continue
        close_block()
        links = 0
        heading = int(name in HEADINGS and not m["end"])
        if m["end"]:
            leave((name,), ENDED[name][1] if name in ENDED else ())
            continue
        if name in CLOSES_P:
            leave(("p",), ("table", "td", "th", "caption"))
        if name in ENDED:
            while leave(*ENDED[name]):
                pass
        if name not in VOID and not m["attributes"].endswith("/"):
            enter(name, m["attributes"])
    if not in_head:
        read(page[at:])
    close_block()
    return [(*b[:3], b[3][0], b[4]) for b in found]


def main_text(page: str) -> str:
    """The blocks that the tree calls main text, joined by an empty line."""
    found = blocks(page)
    has_article = any(b[3] == ARTICLE for b in found)
    shape = [(b[1], b[2] / b[1]) for b in found]
    nothing, grown, kept = (0, 0), tree(), []
    before, after = [nothing] * len(found), [nothing] * len(found)      # the neighbours that are no furniture
    for order, near in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last = nothing
        for i in order:
            near[i] = last
            if found[i][3] != PAGE_FURNITURE:
                last = shape[i]
    for i, b in enumerate(found):
        if classify(grown, (*shape[i], *before[i], *after[i], b[4], b[3] == ARTICLE, b[3] == PAGE_FURNITURE, has_article)):
            kept.append(b[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the column ``html``, plus text and n_chars (its code points); columns of these names are replaced."""
    pages = pages.drop(*[c for c in ("text", "n_chars") if c != column])
    schema = pages.drop(column).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [main_text(p.as_py() or "") for p in batch.column(at)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*(batch.schema.names[i] for i in rest), "text", "n_chars"])

    return pages.mapInArrow(run, schema)
