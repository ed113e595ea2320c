"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings
from .dom import BLOCK, HEADINGS, Page

# Elements and names by which pages mark what is not the article.
NEVER = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input math menu meter nav noscript object optgroup option output progress search select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: The first or last word of a class, id or label.
WORDS = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs colophon consent cookie cookies disqus footer gdpr login mainnav menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination paywall popup promo replies respond share sharing sidebar sidenav signup social sponsor sponsored subnav subscribe subscription "
    "toolbar topnav widget widgets".split()
)
COMMENTS = frozenset("comment commentlist comments disqus replies respond".split())
#: The whole of a class or id.
NAMES = frozenset(
    "aside copyright form header masthead most-read page-header recommended related related-articles related-content related-links related-posts related-stories search search-form secondary site-header skip-link "
    "toc top-header topbar".split()
)
#: A class that begins with one of these says what else a page has.
ABOUT = frozenset("has is no not with without".split())
ARTICLE = frozenset(("article", "main"))
LISTS = frozenset("div dl ol section table td tr ul".split())
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
SAYS = re.compile(r"\b(?:class|id|role|aria-label|hidden|style)\b", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


def marked(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is named as something other than the article, and whether as readers' comments."""
    if "hidden" in attributes or HIDDEN.search(attributes.get("style", "")) or attributes.get("role", "").strip().lower() in ROLES:
        return True, False
    other = comments = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('aria-label', '').replace(' ', '-')}".split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if not parts or parts[0] in ABOUT:
            continue
        ends = {parts[0], parts[-1]}
        comments |= bool(ends & COMMENTS)
        other |= bool(ends & COMMENTS or ends & WORDS) or "-".join(parts) in NAMES
    return other, comments


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters a tag, times a logarithm that is the less the more of them are in links.

    ``share`` is the page's part of characters in links. The logarithm's base grows with the element's links (and, by the page's, with its
    size); one is added to it, since without links it would be 1.
    """
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    within = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(within, 1.0) + 1) / math.log(1 + base)


def dropped(page: Page) -> list[bool]:
    """Which elements are not the article, by what they are and are called; all within them neither."""
    size = len(page.tag)
    own, comments = [False] * size, [False] * size
    for e in range(1, size):
        if page.tag[e] in NEVER:
            own[e] = True
        elif page.tag[e] != "body" and SAYS.search(page.attributes[e]):
            own[e], comments[e] = marked(page.named(e))
    keeps, title = [False] * size, [False] * size  # an article, or the page's first heading, within
    for e in range(size - 1, 0, -1):
        title[e] |= page.tag[e] in ("h1", "main")
        keeps[e] |= page.tag[e] in ARTICLE and not own[e]
        title[page.parent[e]] |= title[e]
        keeps[page.parent[e]] |= keeps[e]
    out, inside, headings = [False] * size, [False] * size, [0, *accumulate(name in HEADINGS for name in page.tag)]
    for e in range(1, size):
        up = page.parent[e]
        inside[e] = inside[up] or page.tag[e] == "article"
        named = own[e] and (page.tag[e] in NEVER or not (title[e] or keeps[e] and not comments[e]) or page.tag[e] in ARTICLE and comments[e])
        header = page.tag[e] == "header" and not (inside[e] and headings[page.last[e]] > headings[e])
        out[e] = out[up] or named or header
    return out


def main_text(html: str) -> str:
    """The article of a page; empty if it has none."""
    page = Page(html)
    size, out = len(page.tag), dropped(page)
    chars, links, link_chars, tags = [0] * size, [0] * size, [0] * size, [0] * size
    for e, text, _, linked in page.texts:
        if not out[e]:
            n = len(" ".join(text.split()))
            chars[e] += n
            link_chars[e] += n if linked else 0
    block = [name in BLOCK for name in page.tag]
    for e in range(size - 1, 0, -1):
        block[page.parent[e]] |= block[e]
    own_chars, own_link_chars, own_tags, own_links, menu = chars[:], link_chars[:], [0] * size, [0] * size, [False] * size
    for e in range(size - 1, 0, -1):  # sums of all within, and of what no block within holds
        up = page.parent[e]
        if not out[e]:
            links[e] += page.tag[e] == "a"
            menu[e] = page.tag[e] in LISTS and links[e] >= 3 and link_chars[e] >= 0.8 * chars[e]
            if menu[e]:
                continue
            for total in (chars, link_chars, links):
                total[up] += total[e]
            tags[up] += tags[e] + 1
            if not block[e]:
                own_chars[up] += own_chars[e]
                own_link_chars[up] += own_link_chars[e]
                own_tags[up] += own_tags[e] + 1
                own_links[up] += own_links[e] + (page.tag[e] == "a")
    if not chars[0]:
        return ""
    for e in range(1, size):
        out[e] |= menu[e] or out[page.parent[e]]
    share = link_chars[0] / chars[0]
    dense = [density(chars[e], tags[e], link_chars[e], links[e], share) if block[e] and not out[e] else 0.0 for e in range(size)]
    sums = [density(own_chars[e], own_tags[e], own_link_chars[e], own_links[e], share) if block[e] and not out[e] else 0.0 for e in range(size)]
    for e in range(size - 1, 0, -1):
        sums[page.parent[e]] += dense[e]
    region = widened(page, block, out, chars, dense, sums)
    parts = []
    for e, text, new, _ in page.texts:
        if region <= e < page.last[region] and not out[e]:
            parts.append(" " + text if new else text)
        elif new:
            parts.append(" ")
    return " ".join("".join(parts).split())


def widened(page: Page, block: list[bool], out: list[bool], chars: list[int], dense: list[float], sums: list[float]) -> int:
    """The subtree with the highest sum of densities, with what belongs to it around it.

    The least density on the way from it to the root is the threshold: in elements that reach it, all the way from the root, the
    subtree with the highest sum is content too. The region grows to the parent while at least half of what that adds,
    headings apart, is content, and to the article element that it is in.
    """
    size = len(page.tag)
    best = list(range(size))
    for e in range(size - 1, 0, -1):
        up = page.parent[e]
        if sums[best[e]] > sums[best[up]] or sums[best[e]] == sums[best[up]] and best[up] != up and best[e] < best[up]:
            best[up] = best[e]
    region = best[0]
    path, e = [], region
    while e >= 0:
        path += [e] if block[e] else []
        e = page.parent[e]
    threshold = min(dense[e] for e in path)
    dense_way, content = [True] * size, [False] * size
    for e in range(size):
        dense_way[e] = not out[e] and block[e] and dense[e] >= threshold and (e == 0 or dense_way[page.parent[e]])
        if dense_way[e]:
            content[best[e]] = True
    found = [0] * size
    for e in range(1, size):
        content[e] |= content[page.parent[e]]
    for e in range(size - 1, -1, -1):
        if out[e]:
            continue
        if content[e] or page.tag[e] in HEADINGS:
            found[e] = chars[e]
        if e:
            found[page.parent[e]] += found[e]
    article = next((e for e in path if page.tag[e] in ARTICLE), None)
    for up in path[1:]:
        more = chars[up] - chars[region]
        if article is not None and up >= article or 2 * (found[up] - found[region]) >= more:
            region = up
        else:
            break
    return region


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: ``(page_id, url, text, n_chars)``; n_chars is the text's code points.

    Elements that by their kind, role or name are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or readers' comments are left
    out, and lists of links. Of what is left each element has a composite text density: characters a tag, less by links. The subtree with the
    highest sum of its children's densities is the main text, widened by the threshold of its path to the body (see ``widened``).
    Character references are decoded, white space in a block becomes one space, blocks are joined by one space in page order.

    Null and empty pages, and pages without such text, have an empty text. Pages of any length are read whole; missing or stray end
    tags, unclosed comments and tags that never end are read as browsers do. Repeated rows and null ids are kept, null urls are null. An empty
    table gives no rows. Extra columns are ignored. Pages are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in strings(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
