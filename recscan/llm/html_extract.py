"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text. A classifier, fitted to a bounded sample of pages whose structure
(article or main elements) tells the article, gives each block a log-odds of being content from its text and
from the words of the elements around it. Its bounded odds, and a bounded cost for structure, become
the block's capacity to one terminal. Neighbours in the page, the closer in the document's tree the more, and
blocks under one parent are tied by smoothness edges, which outvote words and structure where text and
both neighbours agree. The minimum cut, found by maximum flow, labels all blocks at once: those
on the source's side are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import fit_logistic, small_batches

# a quote opens a value only behind an equals sign; a tag without an end stops before the next one, so that no text is read twice
_ATTRS = r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+|[\"'])*+"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|button)\b{_ATTRS}>(?:.*?</(?P=raw)\s*>|.*\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*+)(?P<attrs>{_ATTRS})(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: One attribute: its name and its value, if any; what stands in a value is no name.
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)

#: Tags within a block; white space is what they add at most.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A second one of these ends the first, if that is the innermost open element.
REPEATS = frozenset("p li dt dd tr td th option".split())
# What elements and the words of their class, id and role say of the text below them.
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = {"nav": -1.0, "footer": -1.0, "aside": -1.0, "menu": -1.0, "dialog": -1.0, "header": -0.5}
#: A form may hold a whole page: it only takes back what was said of content around it.
FORM_SAYS = -0.25
#: What stands in one of these itself, not in a paragraph, names its fields.
FORM_TAGS = frozenset("form fieldset legend".split())
CONTENT_WORDS = frozenset("article main content post entry story articlebody maincontent".split())
COMMENT_WORDS = frozenset("comment comments commenter commenters disqus reply replies responses reactions discussion guestbook".split())
BOILER_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies copyright footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "related search share sharing sidebar signup social sponsor sponsored subscribe toolbar".split()
)
#: Words that say half as much, and nothing beside a word for content: they often name a part of the article.
LAYOUT_WORDS = frozenset("header footer".split())
#: Words that do not count beside others.
HELPER_WORDS = frozenset("area bar block bottom box container global inner item items left link links list module outer page panel primary right secondary section site slot top widget wrap wrapper".split())
#: Words of names that tell a state of what is around, not what is inside.
STATE_WORDS = frozenset("closed disabled enabled has hide is layout less no open show template theme with without".split())
#: Evidence of an element from here on holds for all below it, whatever further words say; HIDDEN is not shown at all.
STRONG, HIDDEN = 0.75, -2.0

# ---- blocks -------------------------------------------------------------------------------


class Block(NamedTuple):
    text: str
    tag: str
    says: float  # evidence of the words around: 1 for content to -1 for boilerplate, or HIDDEN
    inside: bool  # within an article or main element, and in nothing within it that is strongly none of it
    linked: int  # characters within links
    parent: int  # number of the element that holds the block's element
    steps: int  # way through the tree from the block before


def name_says(name: str) -> float:
    """What one class or id says: the share of its words that name content, or boilerplate."""
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
    if words & STATE_WORDS:
        return 0.0
    content, boiler = words & CONTENT_WORDS, words & BOILER_WORDS
    if content:
        boiler -= LAYOUT_WORDS
    if boiler:
        said = -sum(0.5 if w in LAYOUT_WORDS and len(boiler) > 1 else 1.0 for w in boiler)
        return max(-1.0, said / len(words - HELPER_WORDS - content))
    rest = words - HELPER_WORDS
    return len(content) / len(rest) if content else -0.5 * bool(rest and rest <= LAYOUT_WORDS)


def element_says(tag: str, attrs: str) -> tuple[float, bool]:
    """(evidence of one element, whether it holds comments): tag and names add up, so that none of them has a veto."""
    said, comments = (0.0 if tag in ("body", "html") else BOILER_TAGS.get(tag, 0.0)), False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return HIDDEN, False
        if name in ("class", "id", "role") and tag not in ("body", "html"):
            for one in value.split():
                one_says = name_says(one)
                said += one_says
                comments = comments or one_says <= -STRONG and bool(set(re.split(r"[^a-z]+", one.lower())) & COMMENT_WORDS)
    return max(-1.0, min(1.0, said)), comments


class _Open(NamedTuple):
    """An element that is open: what holds for the text in it."""

    tag: str = ""
    says: float = 0.0
    inside: bool = False
    comments: bool = False
    number: int = 0


def _below(up: _Open, tag: str, said: float, comments: bool, number: int) -> _Open:
    """What holds in an element: strong evidence stays, weak adds up; an article starts anew but in comments."""
    comments = comments or up.comments
    if tag == "header" and up.inside:
        said = max(said, 0.0)  # the heading of an article, not of the page
    if HIDDEN in (up.says, said):
        says = HIDDEN
    elif up.says <= -STRONG or comments:
        says = min(up.says, -1.0 if comments else 1.0)
    elif tag == "form" and said > -STRONG:
        says = min(up.says + said, FORM_SAYS)
    elif abs(said) >= STRONG:
        says = 1.0 if said > 0 else -1.0
    else:
        says = max(-1.0, min(1.0, up.says + said))
    inside = not comments and said > -STRONG and (up.inside or tag in CONTENT_TAGS)
    return _Open(tag, says, inside, comments, number)


def blocks(page: str, known: dict[tuple[str, str], tuple[float, bool]] | None = None) -> list[Block]:
    """The blocks of a whole page in order: text with references decoded and spaces made one.

    ``known`` keeps what elements say, over the pages of a task.
    """
    known = {} if known is None else known
    found: list[Block] = []
    opened: list[_Open] = [_Open()]
    open_tags = Counter()
    pieces: list[str] = []
    count = links = linked = at = 0
    last = lowest = 1  # depth of the block before, and the least depth since

    def end_block() -> None:
        nonlocal linked, last, lowest
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            depth = len(opened)
            here = opened[-1]
            says = min(here.says, -1.0) if here.tag in FORM_TAGS else here.says
            found.append(Block(text, here.tag, says, here.inside, min(linked, len(text)), opened[-2].number if depth > 1 else 0, last + depth - 2 * min(lowest, depth)))
            last = lowest = depth
        pieces.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m["close"] else 1))
            elif tag == "br":
                pieces.append(" ")
            continue
        end_block()
        if m["close"]:
            while open_tags[tag]:
                ended = opened.pop().tag
                open_tags[ended] -= 1
                if ended == tag:
                    break
            links = 0
        elif tag not in VOID:
            if opened[-1].tag == tag and tag in REPEATS or opened[-1].tag == "p":
                open_tags[opened.pop().tag] -= 1
            lowest = min(lowest, len(opened))
            key = (tag, m["attrs"])
            said = known.get(key)
            if said is None:
                said = element_says(*key)
                if len(known) < KNOWN_ELEMENTS:
                    known[key] = said
            count += 1
            open_tags[tag] += 1
            opened.append(_below(opened[-1], tag, *said, count))
        lowest = min(lowest, len(opened))
    pieces.append(page[at:])
    end_block()
    return found


#: Elements whose evidence a task keeps; others are read again.
KNOWN_ELEMENTS = 4096

# ---- the classifier -----------------------------------------------------------------------

#: At most so many pages, those with the smallest hashed ids, are fitted to.
FIT_PAGES = 2_000
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption dt".split())
ITEMS = frozenset("li td th dd option".split())
#: Weights before fitting: constant, size (doublings of words), share of links, end of a sentence, heading, item, words around.
PRIOR = np.array([-2.0, 0.9, -3.0, 0.7, 0.8, -0.5, 5.5])
#: How far the text, and the words around it, may go either way: a block's text and two neighbours under its parent outvote the words.
TEXT_MOST, WORDS_MOST = 3.0, 6.0
#: How much the weight of words is held to its prior.
WORDS_PULL = 50.0
_SIZES, _SHARES, _SAYS = 8, 5, 9


def cell(b: Block) -> int:
    """The features of a block as one number below 8 x 5 x 2 x 3 x 9, so that samples can be counted."""
    size = min(_SIZES - 1, (b.text.count(" ") + 1).bit_length() - 1)
    share = round(4 * b.linked / len(b.text))
    kind = 1 if b.tag in HEADINGS else 2 if b.tag in ITEMS else 0
    says = max(0, round(4 * b.says) + 4)
    return (((size * _SHARES + share) * 2 + (b.text[-1] in ".!?…。！？")) * 3 + kind) * _SAYS + says


def _features(cells: np.ndarray) -> np.ndarray:
    rest, says = np.divmod(cells, _SAYS)
    rest, kind = np.divmod(rest, 3)
    rest, sentence = np.divmod(rest, 2)
    size, share = np.divmod(rest, _SHARES)
    return np.stack([np.ones(len(cells)), size, share / 4, sentence, kind == 1, kind == 2, says / 4 - 1], axis=1).astype(float)


def cell_odds(weights: np.ndarray) -> list[float]:
    """The log-odds of content of every cell: of its text and of the words around, each bounded."""
    x = _features(np.arange(_SIZES * _SHARES * 6 * _SAYS))
    return (np.clip(x[:, :-1] @ weights[:-1], -TEXT_MOST, TEXT_MOST) + np.clip(x[:, -1] * weights[-1], -WORDS_MOST, WORDS_MOST)).tolist()


def fit_blocks(pages: DataFrame, max_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights of the text classifier, from at most ``max_pages`` pages.

    Pages with an article or main element teach: blocks within are content, all others, and what is
    strongly none of it within, are not. Only counts of cells come to the driver, two for each. Pages without an id are
    not drawn, of repeated ids all are; without a page that teaches the weights are PRIOR.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    drawn = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for page in batch["html"].to_pylist():
                found = blocks(page or "", known)
                if any(b.inside for b in found):
                    rows += [(cell(b), b.inside) for b in found if b.says != HIDDEN]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([y for _, y in rows], pa.bool_())], ["cell", "content"])

    # max_pages bounds what is broadcast: an id a row
    sample = pages.select(F.col("page_id").cast(kind), "html").join(F.broadcast(drawn), "page_id", "left_semi").select("html")
    counts = sample.mapInArrow(scan, "cell int, content boolean").groupBy("cell", "content").count().collect()
    if not counts:
        return PRIOR
    counts.sort(key=lambda r: (r["cell"], r["content"]))
    x, y, n = _features(np.array([r["cell"] for r in counts])), np.array([float(r["content"]) for r in counts]), np.array([float(r["count"]) for r in counts])
    # the text is fitted alone, as names tell most of what is none apart; then the weight of names, the text's odds given
    text = fit_logistic(x[:, :-1], y, PRIOR[:-1], np.full(len(PRIOR) - 1, 1.0), n)
    given = np.stack([np.clip(x[:, :-1] @ text, -TEXT_MOST, TEXT_MOST), x[:, -1]], axis=1)
    both = fit_logistic(given, y, np.array([1.0, PRIOR[-1]]), np.array([1e9, WORDS_PULL]), n)
    return np.append(text, min(both[1], WORDS_MOST))


# ---- the cut ------------------------------------------------------------------------------

#: Smoothness of neighbours two steps apart in the tree, and more if one parent holds both.
NEAR, SAME_PARENT = 1.2, 0.8
#: Costs of structure: of a block within an article or main element, and of others on a page that has one.
WITHIN, OUTSIDE, UNSEEN = 4.5, -2.0, -100.0


def capacities(found: list[Block], odds: list[float]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Terminal capacities (above 0 to the source, for content) and smoothness edges of a page's blocks, in thousandths.

    Articles within boilerplate, as teasers are, count only where there is no other.
    """
    other = OUTSIDE if any(b.inside for b in found) else 0.0
    clear = any(b.inside and b.says > -STRONG for b in found)
    unary = [round(1000 * (odds[cell(b)] + (UNSEEN if b.says == HIDDEN else WITHIN if b.inside and (b.says > -STRONG or not clear) else other))) for b in found]
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = round(1000 * NEAR * 2 / max(2, b.steps))
        j = last.get(b.parent)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0) + round(1000 * SAME_PARENT / (i - j))
        last[b.parent] = i
    return unary, edges


def min_cut(unary: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Labels of a minimum cut: node i pays |unary[i]| against its sign, an edge pays if cut.

    A maximum flow runs from the nodes above 0 to those below, by blocking flows along shortest
    paths; what the source still reaches is content. Of equal cuts the one with the fewest content
    blocks is taken.
    """
    source, sink = [max(u, 0) for u in unary], [max(-u, 0) for u in unary]
    arcs: list[list[int]] = [[] for _ in unary]
    to: list[int] = []
    left: list[int] = []
    for (i, j), w in edges.items():
        # paths of one edge are filled at once
        flow = min(source[i], sink[j], w) - min(source[j], sink[i], w)
        a, b, sent = (i, j, flow) if flow >= 0 else (j, i, -flow)
        source[a] -= sent
        sink[b] -= sent
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += (j, i)
        left += (w - flow, w + flow)
    while True:
        level = [0 if s else -1 for s in source]
        queue = [i for i, s in enumerate(source) if s]
        drained = False
        for u in queue:
            drained = drained or sink[u] > 0
            for e in arcs[u]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not drained:
            return [x >= 0 for x in level]
        ahead = [[e for e in arcs[u] if level[to[e]] == level[u] + 1] if level[u] >= 0 else [] for u in range(len(unary))]
        for start in range(len(unary)):
            path: list[int] = []
            u = start
            while source[start]:
                if sink[u]:
                    sent = min(source[start], sink[u], *(left[e] for e in path))
                    source[start] -= sent
                    sink[u] -= sent
                    for e in path:
                        left[e] -= sent
                        left[e ^ 1] += sent
                    full = next((k for k, e in enumerate(path) if not left[e]), len(path))
                    del path[full:]
                    u = to[path[-1]] if path else start
                    continue
                while ahead[u] and not left[ahead[u][-1]]:
                    ahead[u].pop()
                if ahead[u]:
                    path.append(ahead[u][-1])
                    u = to[path[-1]]
                elif path:  # nothing more gets through here
                    path.pop()
                    u = to[path[-1]] if path else start
                    ahead[u].pop()
                else:
                    break


_PRIOR_ODDS = cell_odds(PRIOR)


def main_text(page: str | None, odds: list[float] = _PRIOR_ODDS, known: dict | None = None) -> str:
    """The content blocks of a page, one line each; empty for null, empty or contentless pages."""
    found = blocks(page or "", known)
    return "\n".join(b.text for b, keep in zip(found, min_cut(*capacities(found, odds)), strict=True) if keep)


def extract_pages(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of text).

    ``weights`` are those of :func:`fit_blocks`, fitted to ``pages`` unless given. Nulls in page_id
    and url stay; a null html gives an empty text; repeated rows stay, an empty table gives no row.
    Other columns are not read. One pass, no shuffle.
    """
    odds = cell_odds(fit_blocks(pages) if weights is None else weights)
    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = [main_text(h, odds, known) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(scan, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
