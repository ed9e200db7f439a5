"""Main text of web pages: flat text blocks, classified by a decision tree over their neighbourhood.

A page is cut at block-level tags into flat blocks of text. A block has its number of words and
its link density, those of the blocks before and after it, and what encloses it: whether an
ancestor is page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments,
by tag, role, class or id), whether one is a main container, whether the page has one at all, and
whether the block is a heading. The tree is grown from the small table ``LABELLED`` and is a few
dozen nodes; pages are independent, so no step shuffles them.

Edge cases: null or empty html has empty text; unclosed tags, comments and quotes end with the
page; text outside any tag is a block; character references are decoded once, unknown ones stay;
scripts, styles and other elements without readable text are left out whole, where their content is
raw up to the next end tag of that name, whatever it holds; a head without an end tag ends at the
first tag or text that may not stand in it; repeated pages give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "furniture", "main", "page_has_main", "heading")

#: Neighbours that any block within or beside a main container may have: words and link density before and after.
_NEIGHBOURS = ((0, 0.0, 0, 0.0), (2, 1.0, 90, 0.0), (70, 0.0, 3, 1.0), (120, 0.05, 80, 0.0), (6, 0.0, 9, 0.0), (3, 1.0, 3, 1.0))
#: Labelled blocks: words, link density, furniture, main, page has main, heading, and 1 for main text; each stands with all those neighbours.
_ENCLOSED = (
    # In a main container: paragraphs and lines of any length, headings, also linked; but no lists of links.
    (1, 0.0, 0, 1, 1, 0, 1), (4, 0.0, 0, 1, 1, 0, 1), (30, 0.1, 0, 1, 1, 0, 1), (150, 0.0, 0, 1, 1, 0, 1), (900, 0.02, 0, 1, 1, 0, 1),
    (14, 0.5, 0, 1, 1, 0, 1), (8, 0.0, 0, 1, 1, 1, 1), (8, 1.0, 0, 1, 1, 1, 1), (1, 1.0, 0, 1, 1, 0, 0), (8, 0.9, 0, 1, 1, 0, 0), (40, 0.8, 0, 1, 1, 0, 0),
    # Page furniture, however long, in a main container or not.
    (1, 1.0, 1, 0, 1, 0, 0), (4, 0.0, 1, 0, 1, 0, 0), (30, 0.1, 1, 0, 1, 0, 0), (150, 0.0, 1, 0, 1, 0, 0), (900, 0.02, 1, 1, 1, 0, 0), (30, 0.0, 1, 1, 1, 0, 0),
    (8, 0.0, 1, 1, 1, 1, 0), (8, 0.0, 1, 0, 0, 1, 0), (4, 0.0, 1, 0, 0, 0, 0), (30, 0.1, 1, 0, 0, 0, 0), (150, 0.0, 1, 0, 0, 0, 0),
    # Outside the main container of a page that has one.
    (1, 1.0, 0, 0, 1, 0, 0), (6, 0.0, 0, 0, 1, 0, 0), (30, 0.0, 0, 0, 1, 0, 0), (150, 0.0, 0, 0, 1, 0, 0), (900, 0.0, 0, 0, 1, 0, 0), (5, 0.0, 0, 0, 1, 1, 0),
)
#: All labelled blocks: the features in the order above, then the label.
LABELLED = tuple((w, d, *n, *rest) for w, d, *rest in _ENCLOSED for n in _NEIGHBOURS) + (
    # No main container on the page: words and links of the block and its neighbours decide.
    (90, 0.02, 8, 0.0, 70, 0.00, 0, 0, 0, 0, 1), (40, 0.10, 60, 0.0, 30, 0.00, 0, 0, 0, 0, 1),
    (22, 0.00, 45, 0.0, 35, 0.00, 0, 0, 0, 0, 1), (18, 0.00, 60, 0.0, 0, 0.00, 0, 0, 0, 0, 1),
    (6, 0.00, 40, 0.0, 50, 0.00, 0, 0, 0, 0, 1), (8, 0.00, 3, 1.0, 80, 0.00, 0, 0, 0, 1, 1),
    (5, 0.00, 50, 0.0, 60, 0.00, 0, 0, 0, 1, 1), (25, 0.20, 5, 0.0, 40, 0.00, 0, 0, 0, 0, 1),
    (30, 0.00, 2, 1.0, 25, 0.00, 0, 0, 0, 0, 1), (16, 0.00, 30, 0.0, 20, 0.10, 0, 0, 0, 0, 1),
    (4, 0.00, 3, 1.0, 4, 1.00, 0, 0, 0, 0, 0), (5, 0.00, 4, 0.0, 3, 0.00, 0, 0, 0, 0, 0),
    (2, 1.00, 3, 1.0, 2, 1.00, 0, 0, 0, 0, 0), (12, 0.80, 20, 0.0, 10, 0.90, 0, 0, 0, 0, 0),
    (30, 0.90, 60, 0.0, 40, 0.90, 0, 0, 0, 0, 0), (7, 0.00, 60, 0.0, 3, 1.00, 0, 0, 0, 0, 0),
    (3, 0.00, 2, 1.0, 3, 1.00, 0, 0, 0, 1, 0), (9, 0.50, 3, 1.0, 6, 0.80, 0, 0, 0, 0, 0),
    (6, 0.00, 8, 0.0, 0, 0.00, 0, 0, 0, 0, 0), (40, 0.70, 5, 1.0, 20, 0.80, 0, 0, 0, 0, 0),
)

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(
    "audio button canvas datalist iframe math noscript object script select style svg template textarea title video".split())
#: Silent elements whose content is not markup, with their end tags.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in "iframe noscript script style textarea title".split()}
#: What may stand in a head.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
_FURNITURE = frozenset("aside dialog footer form menu nav".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Class and id words of furniture, and of main containers.
_FURNITURE_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|copyright|disqus|disclaimer|footer|gdpr|header|legal|login|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|"
    r"search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget)(?:$|[^a-z])")
_MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|entry|main|post|story)(?:$|[^a-z])")
_COMMENT_WORDS = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|comments?|replies|reply|sponsor\w*|promo\w*)(?:$|[^a-z])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    furniture: bool
    main: bool
    heading: bool


def _kind(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """(furniture, main) of an element."""
    furniture, main = tag in _FURNITURE or (tag == "header" and not inside_main), tag in ("article", "main")
    if attributes.strip(" />\n\t\r"):
        values = {m[1].lower(): html_lib.unescape(next((v for v in (m[2], m[3], m[4]) if v is not None), "")) for m in _ATTRIBUTE.finditer(attributes.rstrip(">"))}
        role = values.get("role", "").lower()
        names = f"{values.get('class', '')} {values.get('id', '')}".lower()
        if tag in ("html", "body", "main", "article"):
            furniture |= tag == "article" and bool(_COMMENT_WORDS.search(names))
        else:
            furniture |= bool(_FURNITURE_WORDS.search(names))
            main |= not furniture and bool(_MAIN_WORDS.search(names))
        furniture |= role in _ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        main |= role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
    return furniture, main and not furniture


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, and whether it or an ancestor is furniture, is main
    held: list[str] = []
    linked: list[str] = []
    in_link, heading, silent, in_head, at = 0, False, None, False, 0

    def close() -> None:
        nonlocal heading
        text = " ".join(html_lib.unescape("".join(held)).split())
        if text:
            words = len(text.split(" "))
            links = len(html_lib.unescape(" ".join(linked)).split())
            _, furniture, main = stack[-1] if stack else ("", False, False)
            out.append(Block(text, words, min(1.0, links / words), furniture, main, heading))
        held.clear()
        linked.clear()

    def pop(tag: str, within: frozenset | tuple = ()) -> None:
        """Closes the nearest open ``tag``, unless one of ``within`` stands before it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    def say(text: str) -> None:
        nonlocal in_head
        if in_head and text.strip(" \t\n\r\f"):
            in_head = False
        if text and not in_head:
            held.append(text)
            if in_link:
                linked.append(text)

    while m := _TOKEN.search(page, at):
        start = m.start()
        if silent is None:
            say(page[at:start])
        at = m.end()
        if m[2] is None:
            if silent is None and not in_head and page.startswith("<![CDATA[", start):
                say(html_lib.escape(page[start + 9:at].removesuffix("]]>")))
            continue
        tag, closing, void = m[2].lower(), m[1] == "/", m[3].rstrip(">").endswith("/")
        if silent is None:
            if tag == "head":
                in_head = not closing
                continue
            if in_head:
                in_head = tag not in ("body", "br", "html") if closing else tag in _IN_HEAD
                if in_head and tag not in _SILENT:
                    continue
        if tag in _RAW and not closing and not (void and (tag == "noscript" or silent in ("math", "svg"))):
            end = _RAW[tag].search(page, at)
            at = _TOKEN.match(page, end.start()).end() if end else len(page)
            continue
        if silent is not None:
            # Inside an element without readable text only its own end counts.
            if closing and tag == silent:
                silent = None
            continue
        if tag in _SILENT and not closing:
            if not void:
                silent = tag
            continue
        if tag == "br":
            say(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in _BLOCK:
            close()
            in_link = 0
            if not closing:
                if tag not in ("html", "body"):
                    pop("p", ("table", "td", "th", "button"))
                if tag == "li":
                    pop("li", ("ul", "ol", "menu"))
                elif tag in ("dd", "dt"):
                    pop("dd", ("dl",))
                    pop("dt", ("dl",))
                elif tag in ("td", "th", "tr"):
                    pop("td", ("table",) if tag == "tr" else ("table", "tr"))
                    pop("th", ("table",) if tag == "tr" else ("table", "tr"))
                    if tag == "tr":
                        pop("tr", ("table",))
            heading = not closing and tag in _HEADINGS
        if closing:
            if tag not in _BLOCK and len(stack) > 1 and stack[-1][0] == tag and stack[-1][1] and not stack[-2][1]:
                close()
            pop(tag, () if tag in _BLOCK else _BLOCK)
        elif tag not in _VOID and not void:
            _, furniture, main = stack[-1] if stack else ("", False, False)
            own_furniture, own_main = _kind(tag, m[3], main)
            if tag not in _BLOCK and own_furniture and not furniture:
                close()  # an inline advert or notice is a block of its own
            stack.append((tag, furniture or own_furniture, main or own_main))
    if silent is None:
        say(page[at:])
    close()
    return out


def block_features(blocks: Sequence[Block]) -> np.ndarray:
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.link_density for b in blocks], float)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k < 0 else np.concatenate([v[1:], [0.0]])
    has_main = float(any(b.main and not b.furniture for b in blocks))
    return np.column_stack([words, links, shift(words, -1), shift(links, -1), shift(words, 1), shift(links, 1), [b.furniture for b in blocks],
                            [b.main for b in blocks], np.full(n, has_main), [b.heading for b in blocks]]) if n else np.empty((0, len(FEATURES)))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, threshold, low side, high side), or a label."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:], strict=False):
            low = x[:, f] <= (a + b) / 2
            impurity = sum(2 * s.sum() * (1 - s.mean()) for s in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (a + b) / 2)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def train(labelled: Sequence[Sequence[float]] = LABELLED):
    rows = np.array(labelled, float)
    return grow(rows[:, :-1], rows[:, -1])


def classify(tree, x: np.ndarray) -> list[int]:
    out = []
    for row in x:
        node = tree
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        out.append(node)
    return out


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, kept in zip(blocks, classify(tree, block_features(blocks)), strict=True) if kept)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text", labelled: Sequence[Sequence[float]] = LABELLED) -> DataFrame:
    """``pages`` with the main text of ``html_col`` as column ``into``, in place of ``html_col``."""
    tree = train(labelled)
    keep = [c for c in pages.columns if c not in (html_col, into)]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(into, T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*keep, html_col).mapInArrow(task, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
