"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into blocks: runs of text between block-level tags. A linear classifier turns what is
known of a block (its enclosing tags and class names, link share, length, sentence marks) into a
probability of being content; its two costs are the block's terminal capacities. Neighbouring blocks
and blocks under one parent are tied by edges whose capacity falls with the distance in the tree.
The minimum cut, found by augmenting paths, labels all blocks of the page at once: content is what
stays with the source.

The whole page is read. Character references are decoded, white space inside a block becomes one
space, content blocks are joined in page order by one line feed. A null or empty page, and one
without content, gives an empty text. Broken markup never fails: unclosed elements end with their
parent, an open head at the first content, stray end tags are skipped. Repeated rows give equal rows; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math head iframe object canvas audio video select option textarea button title".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|title|select|canvas|audio|video|object"
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BOILER_TAGS = {"nav": 5.0, "footer": 5.0, "aside": 5.0, "form": 5.0, "menu": 4.0, "header": 2.5, "dialog": 4.0, "address": 1.0}
#: Words in class, id and role attributes that mark what is not the article, and what is.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promotion recommended related reply replies respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe "
    "tags teaser toolbar topbar warning widget alert contentinfo complementary".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Attributes up to a slash that ends the tag; a slash at the end of a bare value belongs to the value.
SELF_CLOSED = r"(?>\"[^\"]*\"|'[^']*'|=\s*+[^\s\"'>]++|=|[^\"'>/=]|/(?!>))*+/>"
#: What may stand in a head; any other element ends one that was left open.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>]){SELF_CLOSED}|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?/][^>]*>",
    re.S | re.I)
ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Words that make a name speak of the page's layout or state, at its start and at its end, and words that add nothing to the word before.
STATE_FIRST = frozenset("has with no not without is are can hide hidden show shown enable enabled disable disabled".split())
STATE_LAST = frozenset("fixed sticky static enabled disabled active inactive open opened closed visible hidden on off true false yes no results result group "
                       "layout page theme template ready loaded supported".split())
FILLER = frozenset("area bar block box btn button buttons card col column container count div icon icons inner item items left link links list "
                   "outer panel posts right row section slot top bottom unit widgets wrap wrapper".split())
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text: its parent's path (element numbers), its tags' evidence, its text and how much of it is linked."""

    path: tuple[int, ...]
    evidence: float
    text: str
    linked: int
    heading: bool


def named(name: str) -> str:
    """What one class, id or role says: "boiler", "content" or "".

    The last word that is no filler decides (``site-footer``); a content word that a boilerplate word qualifies
    is boilerplate (``comment-body``). Names of a state or layout (``has-sidebar``, ``header-fixed``) say nothing.
    """
    w = [x for x in SPLIT.split(CAMEL.sub("-", name).lower()) if x]
    if len(w) > 1 and (w[0] in STATE_FIRST or w[-1] in STATE_LAST):
        return ""
    while len(w) > 1 and w[-1] in FILLER:
        w.pop()
    if not w:
        return ""
    if w[-1] in BOILER_WORDS or w[-1] in CONTENT_WORDS and BOILER_WORDS.intersection(w):
        return "boiler"
    return "content" if w[-1] in CONTENT_WORDS else ""


def marks(tag: str, attrs: str, inside_article: bool) -> float:
    """Evidence of one element for content (positive) or against it."""
    score = -BOILER_TAGS.get(tag, 0.0)
    if tag == "header" and inside_article:
        score = -0.5
    if tag in ("article", "main"):
        score += 2.5
    if attrs and tag not in ("html", "body"):  # their classes speak of the page's layout
        said = {named(x) for m in ATTR.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()}
        if "boiler" in said and tag not in ("article", "main"):
            score -= 5.0
        elif "content" in said:
            score += 2.0
    return score


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # open elements: (tag, number, evidence so far, in a link, in a heading, in an article)
    stack: list[tuple[str, int, float, bool, bool, bool]] = [("", 0, 0.0, False, False, False)]
    number, parts, linked = 0, [], 0
    skip = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = [e for e in stack if e[0] not in INLINE]
                out.append(Block(tuple(e[1] for e in own), own[-1][2], text, linked, any(e[4] for e in own)))
            parts, linked = [], 0

    def close(depth: int) -> None:
        nonlocal skip
        for e in stack[depth:]:
            skip -= e[0] in SKIPPED
        del stack[depth:]

    def text(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if raw and not skip:
            parts.append(raw)
            if any(e[3] for e in stack[1:]):
                linked += len(raw.strip())
    at = 0
    # no tag ends behind the last mark that could end it
    for m in TOKEN.finditer(page) if page.rfind(">") > page.find("<") >= 0 else ():
        text(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] or m[0][1:2].isalpha():  # a self-closed svg or math parts words too
                parts.append(" ")
            continue
        block_level = tag not in INLINE and tag != "br"
        if tag == "br":
            parts.append(" ")
            continue
        if block_level:
            flush()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if not block_level and stack[depth][0] not in INLINE:
                    break
            continue
        if tag not in HEAD:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "head":
                    flush()
                    close(depth)
                    break
        if block_level:
            # an open paragraph, or item of the same list, ends here; inline elements left open end with it
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth][0]
                if name == "p" and tag in CLOSES_P or name in SIBLINGS.get(tag, ()):
                    close(depth)
                    break
                if name not in INLINE:
                    break
        if tag in VOID or m["attrs"].endswith("/") and tag not in INLINE:
            continue
        number += 1
        last = stack[-1]
        evidence = last[2] + (0.0 if tag in INLINE else marks(tag, m["attrs"], last[5]))
        stack.append((tag, number, evidence, last[3] or tag == "a", last[4] or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), last[5] or tag in ("article", "main")))
        skip += tag in SKIPPED
    text(page[at:])
    flush()
    return out


#: The classifier's weights: bias, evidence of the tags, linked share, log of length, sentence mark at the end, heading.
WEIGHTS = (-0.6, 1.0, -3.0, 0.35, 0.5, 0.3)


def log_odds(b: Block) -> float:
    size = len(b.text)
    evidence = max(-8.0, min(4.0, b.evidence))
    values = (1.0, evidence, min(1.0, b.linked / size), math.log1p(size) - 3.0, float(b.text[-1] in ".!?…:;\"'»”"), float(b.heading))
    return sum(w * v for w, v in zip(WEIGHTS, values))


ADJACENT = 0.8
SAME_PARENT = 0.4


def edges(found: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Smoothness edges: page neighbours by their distance in the tree, and successive blocks under one grandparent."""
    last: dict[tuple[int, ...], int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1].path
            common = 0
            while common < min(len(a), len(b.path)) and a[common] == b.path[common]:
                common += 1
            yield i - 1, i, ADJACENT / (1 + max(0, len(a) - common - 1) + max(0, len(b.path) - common - 1))
        parent = b.path[:-1]
        if parent in last and last[parent] != i - 1:
            yield last[parent], i, SAME_PARENT
        last[parent] = i


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. ``gain``: source capacity less sink capacity; ``links``: undirected edges."""
    n = len(gain)
    ahead: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in links:
        ahead[a][b] = ahead[a].get(b, 0.0) + c
        ahead[b][a] = ahead[b].get(a, 0.0) + c
    source, sink = [max(0.0, g) for g in gain], [max(0.0, -g) for g in gain]
    while True:
        # shortest augmenting path from any node with source capacity to any with sink capacity
        came = {i: -1 for i in range(n) if source[i] > 1e-12}
        queue, end = deque(came), -1
        while queue:
            u = queue.popleft()
            if sink[u] > 1e-12:
                end = u
                break
            for v, c in ahead[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if end < 0:
            return [i in came for i in range(n)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(source[path[-1]], sink[end], *[ahead[u][v] for v, u in zip(path, path[1:])])
        source[path[-1]] -= flow
        sink[end] -= flow
        for v, u in zip(path, path[1:]):
            ahead[u][v] -= flow
            ahead[v][u] += flow


def costs(found: list[Block]) -> list[float]:
    """Content cost differences: log(p / (1 - p)) of the classifier, which is the difference of the two terminal capacities."""
    return [max(-12.0, min(12.0, log_odds(b))) for b in found]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    content = minimum_cut(costs(found), list(edges(found)))
    return "\n".join(b.text for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, url, text, n_chars)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
