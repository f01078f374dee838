"""Main text of HTML pages: flat text blocks, judged by a decision tree over their own and their neighbours' figures.

A page becomes a flat list of blocks, the text between block-level tags. A block's figures are its words, its
link density (share of its words inside links), both for the block before and behind it, whether it is a heading, and where
it stands: in a container of the article or of something else. The tree is trained on the small labelled pages below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
UNREAD = frozenset("head script style template noscript svg math iframe object select textarea button canvas audio video title".split())
OTHER = frozenset("nav footer aside form dialog menu fieldset".split())
# An open element of the second kind ends where one of the first begins.
CLOSES = {"p": frozenset("p address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()),
          "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]),
          "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("html body article main section div ul ol dl table aside nav footer header form".split())
# Words in class, id and role that tell a container's purpose.
OTHER_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toc header masthead topbar footer "
    "bottom copyright legal disclaimer comment comments commentlist reply replies respond disqus share sharing social follow related recommended recommendations "
    "trending popular widget login signin signup register search form pagination pager toolbar complementary contentinfo dialog".split())
MAIN_HINTS = frozenset("article content main post entry story articlebody maincontent".split())

IN_MAIN, NO_MAIN, OUTSIDE, IN_OTHER = 2.0, 1.0, 0.0, -1.0
NAMES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "heading", "place")

# Small labelled pages: of each block its label, words, words inside links, heading and place.
_MENU = ((0, 1, 1, 0, -1), (0, 2, 2, 0, -1), (0, 1, 1, 0, -1), (0, 3, 3, 0, -1))
_BARE_MENU = ((0, 1, 1, 0, 0), (0, 2, 2, 0, 0), (0, 2, 2, 0, 0), (0, 1, 1, 0, 0), (0, 3, 3, 0, 0))
LABELLED_PAGES = (
    # an article between the menus, adverts and footer of its page
    (*_MENU, (0, 9, 0, 0, -1), (1, 8, 0, 1, 2), (1, 60, 0, 0, 2), (1, 3, 0, 0, 2), (1, 45, 4, 0, 2), (1, 1, 0, 0, 2), (1, 120, 0, 0, 2), (0, 12, 2, 0, -1)),
    (*_BARE_MENU, (0, 20, 0, 0, 0), (1, 5, 0, 1, 2), (1, 12, 6, 0, 2), (1, 7, 0, 0, 2), (1, 4, 4, 0, 2), (1, 150, 3, 0, 2), (0, 60, 0, 0, 0), (0, 15, 0, 0, 0)),
    ((0, 40, 0, 0, 0), (0, 3, 0, 1, 0), (0, 80, 2, 0, 0), (1, 2, 0, 0, 2), (1, 2, 0, 0, 2), (1, 30, 0, 0, 2), (0, 25, 0, 0, -1), (1, 35, 10, 0, 2), (0, 4, 0, 0, 0)),
    (*_MENU, (0, 100, 5, 0, -1), (1, 200, 0, 0, 2), (1, 20, 2, 0, 2), (1, 9, 9, 0, 2), (1, 70, 0, 0, 2), (0, 6, 0, 1, -1), (0, 45, 0, 0, -1), (0, 30, 0, 0, -1)),
    ((1, 6, 0, 1, 2), (1, 15, 0, 0, 2)), ((1, 4, 4, 1, 2), (1, 90, 1, 0, 2), (1, 11, 5, 0, 2), (0, 3, 3, 0, 0), (0, 90, 0, 0, 0)),
    ((0, 14, 0, 0, 0), (1, 25, 8, 0, 2), (1, 100, 30, 0, 2), (1, 3, 3, 0, 2), (0, 9, 0, 0, 0), (0, 200, 0, 0, -1), (0, 70, 0, 0, -1), (0, 2, 0, 1, -1)),
    # short last words of an article
    (*_MENU, (1, 70, 0, 0, 2), (1, 5, 0, 0, 2), (0, 2, 0, 0, -1)), ((1, 8, 0, 1, 2), (1, 40, 0, 0, 2), (1, 6, 0, 0, 2)), ((1, 30, 0, 0, 2), (1, 8, 0, 0, 2), (0, 1, 1, 0, 0)),
    ((0, 3, 0, 0, 0), (1, 4, 0, 1, 2), (1, 7, 0, 0, 2), (1, 5, 0, 0, 2), (0, 2, 2, 0, -1)), ((1, 6, 0, 0, 2),), ((1, 90, 9, 0, 2), (1, 4, 1, 0, 2), (0, 1, 0, 0, -1)),
    # an article of short lines, some with links
    (*_MENU, (1, 3, 0, 0, 2), (1, 1, 0, 0, 2), (1, 12, 0, 0, 2), (1, 1, 0, 0, 2), (1, 4, 1, 0, 2), (1, 2, 0, 0, 2), (1, 2, 0, 0, 2), (1, 20, 5, 0, 2), (1, 1, 0, 0, 2), (1, 5, 2, 0, 2), (1, 3, 0, 0, 2),
     (1, 14, 0, 0, 2), (1, 1, 0, 0, 2), (1, 35, 0, 0, 2), (1, 2, 0, 0, 2), (1, 7, 0, 0, 2), (1, 3, 1, 0, 2), (1, 9, 3, 0, 2), (1, 1, 0, 0, 2), (0, 6, 1, 0, -1)),
    # a list of links inside the article is a menu
    ((1, 7, 0, 1, 2), (1, 55, 0, 0, 2), (0, 5, 5, 0, 2), (0, 6, 6, 0, 2), (0, 4, 4, 0, 2), (0, 7, 7, 0, 2), (1, 48, 0, 0, 2)),
    ((1, 9, 0, 1, 2), (0, 2, 2, 0, 2), (0, 3, 3, 0, 2), (0, 2, 2, 0, 2), (1, 65, 3, 0, 2), (1, 80, 0, 0, 2), (0, 1, 1, 0, -1), (0, 1, 1, 0, -1)),
    # pages that mark no article
    (*_BARE_MENU, (1, 7, 0, 1, 0), (1, 55, 0, 0, 0), (1, 6, 0, 0, 0), (1, 70, 4, 0, 0), (1, 25, 2, 0, 0), (0, 8, 1, 0, 0), (0, 2, 2, 0, 0), (0, 1, 1, 0, 0)),
    (*_BARE_MENU, (0, 3, 0, 0, 0), (0, 5, 3, 0, 0), (1, 6, 0, 1, 0), (1, 40, 0, 0, 0), (1, 35, 1, 0, 0), (1, 4, 0, 0, 0), (1, 90, 0, 0, 0), (0, 4, 4, 0, 0), (0, 6, 0, 0, 0)),
    (*_MENU, (1, 30, 0, 0, 0), (1, 22, 3, 0, 0), (1, 60, 0, 0, 0), (1, 18, 0, 0, 0), (0, 20, 17, 0, 0), (0, 30, 26, 0, 0), (0, 5, 0, 0, -1), (0, 40, 0, 0, -1)),
    ((0, 4, 4, 0, 0), (0, 3, 0, 0, 0), (0, 6, 6, 0, 0), (0, 2, 0, 0, 0), (0, 5, 5, 0, 0), (0, 7, 4, 0, 0), (0, 3, 3, 0, 0)),
    ((1, 50, 0, 0, 0), (1, 16, 0, 0, 0), (1, 33, 8, 0, 0), (0, 3, 3, 0, 0), (0, 2, 2, 0, 0)),
    (*_BARE_MENU, (1, 9, 0, 1, 0), (1, 75, 0, 0, 0), (1, 42, 0, 0, 0)), ((1, 30, 2, 0, 0), (1, 110, 0, 0, 0)), (*_MENU, (1, 65, 3, 0, 0), (0, 2, 2, 0, 0)),
    ((1, 60, 0, 0, 0), (1, 2, 0, 0, 0), (1, 70, 0, 0, 0), (1, 3, 0, 0, 0), (1, 50, 0, 0, 0), (1, 1, 0, 0, 0), (1, 65, 0, 0, 0)),
    (*_BARE_MENU, (1, 28, 0, 0, 0), (1, 36, 1, 0, 0), (0, 2, 0, 0, 0)), ((1, 45, 0, 0, 0), (1, 21, 0, 0, 0), (0, 7, 0, 0, -1)),
    # blocks of any size in other containers, or outside the article, beside long paragraphs
    *(((0, n, k, 0, place), (1, near, 0, 0, 2), (0, n, k, 0, place)) for place in (-1, 0) for n in (1, 4, 9, 25, 80, 160) for k in (0, n // 2, n) for near in (70, 100, 220)),
    *(((0, n, k, 1, place), (1, 90, 0, 0, 2), (1, 5, 5, 0, 2), (1, 90, 0, 0, 2)) for place in (-1, 0) for n, k in ((2, 0), (6, 6), (9, 4))),
    # long links before and behind the paragraphs of pages that mark no article
    *(((0, n, n, 0, 0), (1, near, 0, 0, 0), (1, 60, 2, 0, 0), (0, n, n, 0, 0)) for n in (4, 6, 9, 15) for near in (70, 100, 130, 250)),
    *(((0, n, n, 0, -1), (1, near, 0, 0, 0), (0, n, k, 0, -1)) for n, k in ((4, 4), (9, 0), (40, 3)) for near in (70, 130)),
)


_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?(?P<loose>[a-zA-Z][^\s/>]*)(?P<more>[^>]*)(?:>|\Z)""", re.S)
_PURPOSE = re.compile(r"""(?:\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_HINT = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


def _purpose(name: str, rest: str, above: float, in_article: bool) -> float:
    """Where the content of an element stands, given where the element does."""
    if above == IN_OTHER or name in OTHER or rest and _HIDDEN.search(rest):
        return IN_OTHER
    if name in ("html", "body"):
        return above
    hints, plain_main = set(), False
    if rest:
        for _, *values in _PURPOSE.findall(rest):
            for token in " ".join(values).lower().split():
                words = set(_HINT.findall(token))
                hints |= words
                plain_main |= not words.isdisjoint(MAIN_HINTS) and words.isdisjoint(OTHER_HINTS)
    main, other = not hints.isdisjoint(MAIN_HINTS), not hints.isdisjoint(OTHER_HINTS)
    # An article may say that it has a sidebar; comments and adverts are never part of it.
    if other and not main or not hints.isdisjoint(("comment", "comments", "advert")) or "sidebar" in hints and not plain_main:
        return IN_OTHER
    if name == "header" and not in_article:
        return IN_OTHER
    return IN_MAIN if main or name in ("article", "main") else above


def blocks(page: str) -> list[tuple[str, int, int, bool, float]]:
    """Text, words, words inside links, heading and place of each block of a page with at least one word."""
    out: list[tuple[str, int, int, bool, float]] = []
    stack: list[tuple[str, float, bool]] = []  # name, place, unread
    pieces: list[str] = []
    link_pieces: list[str] = []
    links = 0

    def flush() -> None:
        if pieces:
            words = "".join(pieces).split()
            if words:
                heading = any(len(n) == 2 and n[0] == "h" and n[1].isdigit() for n, _, _ in stack)
                out.append((" ".join(words), len(words), min(len(words), sum(len(x.split()) for x in link_pieces)), heading, stack[-1][1] if stack else OUTSIDE))
            pieces.clear()
            link_pieces.clear()

    def add(text: str) -> None:
        if text and not (stack and stack[-1][2]):
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                link_pieces.append(text)

    def close(at: int) -> None:
        nonlocal links
        if any(n not in INLINE for n, _, _ in stack[at:]):
            flush()
        links -= sum(n == "a" for n, _, _ in stack[at:])
        del stack[at:]

    at = 0
    while m := _TAG.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if m["cdata"]:
            add(m["cdata"].replace("&", "&amp;"))
        name = (m["name"] or m["loose"] or "").lower()
        if not name:
            continue
        rest = m["rest"] or m["more"] or ""
        if page[m.start() + 1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in SCOPES and name not in SCOPES:  # an end tag does not reach out of its container
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name not in INLINE:
            flush()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES and name in CLOSES[stack[i][0]]:
                close(i)
                break
            if stack[i][0] in SCOPES:
                break
        if name in VOID:
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if rest.endswith("/") and name in ("svg", "math"):
            continue
        above = stack[-1][1] if stack else OUTSIDE
        place = above if name in INLINE else _purpose(name, rest, above, any(n == "article" for n, _, _ in stack))
        unread = bool(stack and stack[-1][2]) or name in UNREAD
        stack.append((name, place, unread))
        links += name == "a"
    add(page[at:])
    flush()
    return out


def figures(found: list[tuple[str, int, int, bool, float]]) -> list[tuple[float, ...]]:
    """NAMES of each block. Without a container of the article anywhere, a block outside others stands in ``NO_MAIN``."""
    outside = OUTSIDE if any(b[4] == IN_MAIN for b in found) else NO_MAIN
    own = [(0, 0.0), *((n, k / n) for _, n, k, _, _ in found), (0, 0.0)]
    return [(*own[i + 1], *own[i], *own[i + 2], float(b[3]), outside if b[4] == OUTSIDE else b[4]) for i, b in enumerate(found)]


def labelled_rows(pages=LABELLED_PAGES) -> list[tuple[float, list[float]]]:
    return [(float(b[0]), list(map(float, x))) for page in pages for b, x in zip(page, figures([("", *b[1:4], float(b[4])) for b in page]))]


def fit_tree(spark: SparkSession, pages=LABELLED_PAGES):
    """The decision tree as nested (figure, threshold, at most, above); a leaf is its label."""
    rows = spark.createDataFrame(labelled_rows(pages), "label double, figures array<double>").coalesce(1)
    rows = rows.select("label", array_to_vector("figures").alias("features"))
    root = DecisionTreeClassifier(maxDepth=8, maxBins=64, seed=1).fit(rows)._java_obj.rootNode()

    def walk(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(root)


def is_main(tree, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree == 1.0


def main_text(tree, page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, x in zip(found, figures(found)) if is_main(tree, x))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the blocks that the tree takes for main text, joined by one space.

    Character references are decoded and white space in a block becomes one space. A null or empty page has an empty text.
    Unclosed and misplaced tags end where their container does. Pages of any length are read whole, row by row and without
    a shuffle; repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    tree = fit_tree(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(tree, p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
