"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page, read up to their end tag.
RAW = frozenset("script style title textarea noscript template iframe svg select option button object".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Items whose start tag ends an open one, whatever of SOFT lies in between.
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
SOFT = frozenset("address div p".split())
#: Parts of a table whose start tag ends the parts of the same table that are open.
TABLE_PARTS = {
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "thead": ("thead", "tbody", "tfoot", "tr"),
    "tbody": ("thead", "tbody", "tfoot", "tr"), "tfoot": ("thead", "tbody", "tfoot", "tr"),
}
#: Elements and class, id or role words of what surrounds an article.
AROUND = frozenset("nav footer aside form menu dialog".split())
AROUND_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments "
    "complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header masthead menu "
    "menubar meta modal nav navbar navigation newsletter notice notices notification overlay pagination pager "
    "popup promo promotion promoted recommended related reply respond search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: A class such as "no-sidebar" describes a layout, not the element.
LAYOUT_WORDS = frozenset("has no with without".split())
SIDES = frozenset("left right layout".split())
ARTICLE = frozenset("article main".split())
#: What an article inside is part of; other surroundings, as a form over the whole page, may hold the article.
APART = frozenset(
    "ad ads advert adverts advertisement advertising comment comments dialog aside footer menu modal nav popup promo "
    "promotion recommended related reply respond sidebar sponsor sponsored teaser".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | </?[a-zA-Z!?][^>]*+(?:>|\Z)
      | </[^>]*+(?:>|\Z)
      | (?P<text>[^<]++|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Any attribute: name, and its value in double, single or no quotes.
ANY_ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MAY_HIDE = re.compile(r"hidden|style", re.I)
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
PIECE = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "around", "in_article", "page_has_article", "heading",
)
#: Labelled blocks: the values of FEATURES, then 1 for main text. They describe typical blocks
#: of pages with and without article markup; they were written for this purpose, not collected.
LABELLED = (
    # paragraphs of marked articles, long, short, beside other things
    (60, 0.00, 45, 0.00, 70, 0.00, 0, 1, 1, 0, 1),
    (25, 0.04, 60, 0.00, 40, 0.10, 0, 1, 1, 0, 1),
    (8, 0.00, 30, 0.00, 50, 0.00, 0, 1, 1, 0, 1),
    (2, 0.00, 30, 0.00, 12, 0.00, 0, 1, 1, 0, 1),
    (1, 0.00, 9, 0.00, 0, 0.00, 0, 1, 1, 0, 1),
    (1, 0.00, 5, 1.00, 20, 0.00, 0, 1, 1, 0, 1),
    (120, 0.20, 8, 0.00, 3, 0.00, 0, 1, 1, 0, 1),
    (4, 0.00, 2, 1.00, 80, 0.00, 0, 1, 1, 1, 1),
    (9, 0.00, 1, 1.00, 5, 0.00, 0, 1, 1, 1, 1),
    (3, 0.00, 90, 0.00, 60, 0.00, 0, 1, 1, 1, 1),
    (14, 0.30, 40, 0.00, 25, 0.00, 0, 1, 1, 0, 1),
    (5, 0.00, 6, 0.00, 4, 1.00, 0, 1, 1, 0, 1),
    (1, 0.00, 1, 0.00, 1, 0.00, 0, 1, 1, 0, 1),
    (17, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1, 0, 1),
    (90, 0.00, 2, 1.00, 2, 1.00, 0, 1, 1, 0, 1),
    (6, 0.35, 9, 0.00, 5, 0.00, 0, 1, 1, 0, 1),
    (11, 0.45, 3, 1.00, 14, 0.00, 0, 1, 1, 0, 1),
    (2, 0.00, 3, 1.00, 2, 1.00, 0, 1, 1, 1, 1),
    (210, 0.00, 150, 0.00, 7, 0.00, 0, 1, 1, 0, 1),
    (3, 0.00, 8, 0.00, 15, 1.00, 0, 1, 1, 0, 1),
    # lists of links inside a marked article
    (3, 1.00, 50, 0.00, 3, 1.00, 0, 1, 1, 0, 0),
    (4, 1.00, 4, 1.00, 2, 1.00, 0, 1, 1, 0, 0),
    (6, 0.90, 30, 0.00, 5, 1.00, 0, 1, 1, 0, 0),
    (2, 1.00, 3, 1.00, 0, 0.00, 0, 1, 1, 0, 0),
    # menus, adverts, footers, comments, forms and notices, wherever they stand
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 1, 0, 0),
    (2, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0, 0),
    (12, 0.00, 1, 1.00, 8, 0.00, 1, 0, 1, 0, 0),
    (40, 0.00, 60, 0.00, 60, 0.00, 1, 1, 1, 0, 0),
    (15, 0.00, 70, 0.00, 0, 0.00, 1, 0, 1, 0, 0),
    (9, 0.20, 30, 0.00, 0, 0.00, 1, 0, 0, 0, 0),
    (55, 0.00, 10, 0.00, 60, 0.00, 1, 0, 0, 0, 0),
    (5, 0.00, 40, 0.00, 30, 0.00, 1, 1, 1, 1, 0),
    (3, 0.00, 0, 0.00, 4, 1.00, 1, 0, 0, 1, 0),
    (80, 0.05, 80, 0.00, 90, 0.00, 1, 1, 1, 0, 0),
    (140, 0.00, 3, 1.00, 2, 1.00, 1, 0, 1, 0, 0),
    (95, 0.00, 60, 0.00, 6, 0.00, 1, 0, 0, 0, 0),
    (200, 0.10, 0, 0.00, 8, 1.00, 1, 0, 1, 0, 0),
    (110, 0.00, 45, 0.00, 30, 0.00, 1, 1, 1, 0, 0),
    (35, 0.00, 90, 0.00, 0, 0.00, 1, 1, 1, 0, 0),
    (65, 0.00, 2, 0.00, 55, 0.00, 1, 0, 0, 0, 0),
    (28, 0.00, 25, 0.00, 1, 0.00, 1, 0, 1, 0, 0),
    (7, 0.00, 12, 0.00, 9, 0.00, 1, 0, 1, 0, 0),
    (1, 0.00, 20, 0.00, 40, 0.00, 1, 0, 0, 0, 0),
    (4, 0.00, 100, 0.00, 75, 0.00, 1, 1, 1, 1, 0),
    (17, 0.40, 6, 0.00, 5, 0.60, 1, 0, 1, 0, 0),
    (10, 0.00, 5, 0.00, 120, 0.00, 1, 0, 1, 0, 0),
    (50, 0.00, 70, 0.00, 4, 0.00, 1, 0, 0, 0, 0),
    (19, 0.05, 19, 0.00, 21, 0.00, 1, 0, 0, 0, 0),
    # what stands outside the article of a page that marks one
    (30, 0.00, 1, 1.00, 40, 0.00, 0, 0, 1, 0, 0),
    (6, 0.00, 2, 1.00, 9, 0.00, 0, 0, 1, 1, 0),
    (10, 0.50, 50, 0.00, 4, 1.00, 0, 0, 1, 0, 0),
    (70, 0.00, 40, 0.00, 0, 0.00, 0, 0, 1, 0, 0),
    (95, 0.00, 30, 0.00, 5, 0.00, 0, 0, 1, 0, 0),
    (120, 0.00, 60, 0.00, 45, 0.00, 0, 0, 1, 0, 0),
    (16, 0.00, 0, 0.00, 35, 0.00, 0, 0, 1, 0, 0),
    (24, 0.00, 90, 0.00, 65, 0.00, 0, 0, 1, 0, 0),
    (3, 1.00, 3, 1.00, 0, 0.00, 0, 0, 1, 0, 0),
    # pages without article markup: running text
    (50, 0.00, 40, 0.00, 60, 0.00, 0, 0, 0, 0, 1),
    (30, 0.10, 5, 1.00, 45, 0.00, 0, 0, 0, 0, 1),
    (22, 0.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0, 1),
    (90, 0.15, 4, 0.00, 3, 1.00, 0, 0, 0, 0, 1),
    (18, 0.00, 3, 0.00, 30, 0.00, 0, 0, 0, 0, 1),
    (16, 0.20, 20, 0.00, 18, 0.00, 0, 0, 0, 0, 1),
    (6, 0.00, 40, 0.00, 50, 0.00, 0, 0, 0, 0, 1),
    (3, 0.00, 25, 0.10, 30, 0.00, 0, 0, 0, 0, 1),
    (8, 0.00, 35, 0.00, 20, 0.05, 0, 0, 0, 0, 1),
    (20, 0.00, 21, 0.00, 2, 0.00, 0, 0, 0, 0, 1),
    (35, 0.00, 19, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (40, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (24, 0.05, 3, 1.00, 4, 0.00, 0, 0, 0, 0, 1),
    (150, 0.00, 12, 0.00, 5, 1.00, 0, 0, 0, 0, 1),
    (17, 0.00, 45, 0.00, 3, 0.00, 0, 0, 0, 0, 1),
    (28, 0.10, 2, 1.00, 1, 1.00, 0, 0, 0, 0, 1),
    (65, 0.00, 70, 0.00, 6, 0.00, 0, 0, 0, 0, 1),
    # ... its headings
    (5, 0.00, 3, 1.00, 40, 0.00, 0, 0, 0, 1, 1),
    (7, 0.00, 50, 0.00, 60, 0.00, 0, 0, 0, 1, 1),
    (4, 0.00, 0, 0.00, 25, 0.00, 0, 0, 0, 1, 1),
    # ... and menus, captions and small print
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (4, 0.80, 30, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (20, 0.70, 50, 0.00, 40, 0.00, 0, 0, 0, 0, 0),
    (30, 0.90, 4, 1.00, 6, 0.90, 0, 0, 0, 0, 0),
    (5, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0),
    (7, 0.00, 40, 0.00, 2, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 1, 1.00, 5, 0.00, 0, 0, 0, 0, 0),
    (9, 0.10, 3, 0.50, 0, 0.00, 0, 0, 0, 0, 0),
    (3, 0.00, 6, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    (6, 0.00, 30, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    (8, 0.00, 2, 1.00, 6, 0.00, 0, 0, 0, 0, 0),
    (11, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (10, 0.00, 60, 0.00, 4, 0.00, 0, 0, 0, 0, 0),
    (12, 0.00, 5, 0.00, 2, 0.00, 0, 0, 0, 0, 0),
    (3, 0.00, 4, 1.00, 2, 1.00, 0, 0, 0, 1, 0),
    (2, 0.00, 40, 0.00, 3, 1.00, 0, 0, 0, 1, 0),
    (5, 1.00, 3, 1.00, 30, 0.00, 0, 0, 0, 1, 0),
)


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    around: int
    in_article: int
    heading: int


class _Open(NamedTuple):
    name: str
    around: bool
    article: bool
    hidden: bool
    apart: bool = False
    rigid: int = -1  # place of the nearest element, itself included, that is not SOFT


def is_hidden(attributes: str) -> bool:
    """Whether an element is hidden by a hidden attribute, aria-hidden="true" or display:none in its style."""
    if not MAY_HIDE.search(attributes):
        return False
    values: dict[str, str] = {}
    for name, *value in ANY_ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), html.unescape("".join(value)).strip().lower())
    displays = DISPLAY.findall(values.get("style", ""))
    return (
        values.get("hidden", "until-found") != "until-found"
        or values.get("aria-hidden") == "true"
        or displays[-1:] == ["none"]
    )


def blocks(page: str) -> tuple[list[Block], bool]:
    """The flat text blocks of a page, in order, and whether it marks an article.

    Unclosed and misplaced tags are taken as browsers do: an end tag closes what is open
    inside its element and is ignored without one; a paragraph ends where a block begins, a
    list item, term, row or cell where the next one of its list or table does.  An article
    inside a form, or inside an element whose class names its layout, is the page's article.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    pieces: list[str] = []
    linked: list[str] = []
    links, has_article = 0, False
    heading = False
    places: defaultdict[str, list[int]] = defaultdict(list)
    unclosed: set[str] = set()

    def close_from(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().name].pop()

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words and not (stack and stack[-1].hidden):
                link_words = min(len(words), len(html.unescape(" ".join(linked)).split()))
                top = stack[-1] if stack else _Open("", False, False, False)
                out.append(
                    Block(" ".join(words), len(words), link_words, int(top.around), int(top.article), int(heading))
                )
        pieces, linked = [], []

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.match(page, at)
        at = token.end()
        if (text := token["text"]) is not None:
            pieces.append(text)
            if links:
                linked.append(text)
            continue
        if token["name"] is None:
            continue
        name = token["name"].lower()
        closing = bool(token["close"])
        if name in RAW:
            if not closing and not token["attributes"].endswith("/") and name not in unclosed:
                found = RAW_END[name].search(page, at)
                if found is None:
                    unclosed.add(name)
                at = found.end() if found else (end if name in ("script", "style", "title", "textarea") else at)
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK:
            flush()
            links = 0
            heading = name in HEADINGS and not closing
            if closing:
                if places[name]:
                    close_from(places[name][-1])
                continue
            while stack and stack[-1].name == "p":
                close_from(len(stack) - 1)
            if name in ("hr", "body", "html"):
                continue
            if name in ITEMS and stack and (rigid := stack[-1].rigid) >= 0 and stack[rigid].name in ITEMS[name]:
                close_from(rigid)
            elif name in TABLE_PARTS:
                table = places["table"][-1] if places["table"] else -1
                inside = [places[c][bisect_right(places[c], table) :][:1] for c in TABLE_PARTS[name]]
                close_from(min((i[0] for i in inside if i), default=len(stack)))
            above = stack[-1] if stack else _Open("", False, False, False)
            words: set[str] = set()
            plain: set[str] = set()
            for _, *values in ATTRIBUTE.findall(token["attributes"]):
                for value in "".join(values).split():
                    pieces_of = [p.lower() for p in PIECE.findall(value)]
                    if not LAYOUT_WORDS.intersection(pieces_of):
                        words.update(pieces_of)
                        # In sidebar-left the first word describes the second; an ad-slot is an ad.
                        if not SIDES.intersection(pieces_of):
                            plain.update(pieces_of)
            starts_article = name in ARTICLE or "main" in words and "article" in words
            around = (
                name in AROUND
                or name == "header" and not above.article
                or name != "main" and bool(words & AROUND_WORDS) and not (name == "article" and not words & {"comment", "related", "promo", "teaser", "sponsored"})
            )
            # The article itself may lie in a form or a layout, but not in what stands beside articles.
            surrounded = above.around and not (starts_article and not above.apart)
            if starts_article and not around and not surrounded:
                has_article = True
            hidden = above.hidden or is_hidden(token["attributes"])
            apart = above.apart or around and (name in APART or bool(plain & APART))
            places[name].append(len(stack))
            stack.append(
                _Open(
                    name,
                    surrounded or around,
                    above.article or starts_article and not around,
                    hidden,
                    apart,
                    (above.rigid if name in SOFT else len(stack)),
                )
            )
    flush()
    return out, has_article


def vectors(found: list[Block], has_article: bool) -> list[tuple[float, ...]]:
    """FEATURES of each block; beyond the ends stand empty blocks."""
    sizes = [(float(b.words), b.link_words / b.words) for b in found]
    around = [(0.0, 0.0), *sizes, (0.0, 0.0)]
    return [
        (*around[i + 1], *around[i], *around[i + 2], b.around, b.in_article, int(has_article), b.heading)
        for i, b in enumerate(found)
    ]


class Node(NamedTuple):
    """A leaf has a verdict; another node sends values up to ``cut`` left."""

    verdict: int
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def train(rows: tuple[tuple[float, ...], ...] = LABELLED, depth: int = 8) -> Node:
    """A classification tree by Gini impurity; ties go to the earlier feature and lower cut."""
    positive = sum(r[-1] for r in rows)
    verdict = int(2 * positive >= len(rows))
    if depth == 0 or positive in (0, len(rows)):
        return Node(verdict)

    def impurity(part: list) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = (impurity(list(rows)) - 1e-9, None)
    for feature in range(len(rows[0]) - 1):
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left = [r for r in rows if r[feature] <= cut]
            right = [r for r in rows if r[feature] > cut]
            score = impurity(left) + impurity(right)
            if score < best[0]:
                best = (score, (feature, cut, left, right))
    if best[1] is None:
        return Node(verdict)
    feature, cut, left, right = best[1]
    return Node(verdict, feature, cut, train(tuple(left), depth - 1), train(tuple(right), depth - 1))


def decide(node: Node, vector: tuple[float, ...]) -> int:
    while node.feature >= 0:
        node = node.left if vector[node.feature] <= node.cut else node.right
    return node.verdict


def main_text(page: str, tree: Node) -> str:
    found, has_article = blocks(page)
    kept = zip(found, vectors(found, has_article), strict=True)
    return "\n".join(b.text for b, vector in kept if decide(tree, vector))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points).

    The text consists of the blocks that the tree, trained on LABELLED, takes for main text:
    character references decoded, white space inside a block one space, blocks joined by a
    line feed in page order.  Nothing is cut.  A null page counts as empty; an empty page, or one
    without main text, gives ''.  Null keys and URLs stay null, repeated rows give repeated
    results, other columns are ignored.
    """
    tree = train()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p or "", tree) for p in batch["_page"]]
            yield pd.DataFrame(
                {"_key": batch["_key"], "_url": batch["_url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    kind = pages.schema[key].dataType.simpleString()
    return (
        pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_page"))
        .mapInPandas(extract, f"_key {kind}, _url string, text string, n_chars long")
        .withColumnsRenamed({"_key": key, "_url": url})
    )
