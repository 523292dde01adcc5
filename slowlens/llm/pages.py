"""Main text of web pages by site template removal.

Every page becomes a tree of elements.  Subtrees that hold text are hashed by tag and text, and
Spark counts for each host on how many pages a hash stands beside something else: pages
count by their longest block outside the subtree, so copies and near copies of one article
count once, however many there are, and their paragraphs stay.  A subtree that stands beside
``least_pages`` different blocks and beside ``growth`` times the square root of the host's
different pages is deleted: plain menus, footers and notices that a site repeats, also where
they have no telling name and stand on a tenth of a large host only.  Inside an article or main
element, where sentences recur too, a subtree must stand beside as many blocks as ``share`` of
the pages.  What differs from page to page but is no article (a footer with a number in it)
cannot be found by counting; it is deleted by its tag, role or class name, as are forms,
scripts and styles.  If the rest has article elements only they count, else a main element,
else the whole body.  So on pages whose articles are marked, tags and names do nearly all of
the work; counts do it where pages have no such mark.

Counts are sums per host and hash with map-side combine, so a host with a third of all
pages is no single task.  A host has at most (elements of all pages / needed pages) frequent
hashes; they are joined to its pages, broadcast only if their bytes allow.  Parsing is one page at a
time.  A null or blank page gives an empty text; a page without host keeps all that the tags
leave; equal pages count once; repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from slowlens.llm.catalog import query
from slowlens.llm.common import saved, table

LEAST_PAGES = 8
GROWTH = 2.0
SHARE = 0.5
BROADCAST_HASHES = 1_000_000
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select svg canvas object audio video dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments respond reply replies disqus "
    "share sharing social newsletter subscribe subscription signup login popup modal overlay related recommended toolbar widget widgets skip".split()
)
KEPT_NAMES = frozenset("html body article main".split())
#: An opening tag of the key ends open elements of the value.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SCOPES = frozenset("html body article section div main td th li ul ol table aside nav header footer blockquote form".split())


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def tree_of(page: str) -> Element:
    """The elements of a page; texts are children of type ``str`` with references decoded."""
    root = Element("#root")
    open_elements, at, n = [root], 0, len(page)

    def text(lo, hi):
        if hi > lo:
            open_elements[-1].children.append(html.unescape(page[lo:hi]))

    def close(tags, stops):
        for i in range(len(open_elements) - 1, 0, -1):
            if open_elements[i].tag in tags:
                del open_elements[i:]
                return
            if open_elements[i].tag in stops:
                return

    while m := TAG.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            close({tag}, () if tag in SCOPES else SCOPES - {tag})
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, SCOPES)
        if tag in CLOSES:
            close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        attributes = m[3] or m[6] or ""
        element = Element(tag, attributes)
        open_elements[-1].children.append(element)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            if tag == "textarea":
                element.children.append(html.unescape(page[at : end.start() if end else n]))
            at = end.end() if end else n
        elif tag not in VOID:
            open_elements.append(element)
    text(at, n)
    return root


def unwanted(e: Element, in_article: bool) -> bool:
    """Whether tag, role or names say that an element is no part of an article."""
    if e.tag in DROPPED or e.tag in RAW or (e.tag == "header" and not in_article):
        return True
    if not e.attributes or e.tag in KEPT_NAMES and not in_article:
        return False
    for m in NAMES.finditer(e.attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
        if name in ("class", "id") and not DROPPED_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def hash_subtrees(root: Element) -> dict[int, int]:
    """Hash of tag and text below, by identity, of every block element that holds text."""
    found: dict[int, int] = {}
    texts: dict[int, str] = {}
    stack = [(root, False)]
    while stack:  # without recursion: pages may nest deeply
        e, ready = stack.pop()
        if not ready:
            stack.append((e, True))
            stack.extend((c, False) for c in e.children if isinstance(c, Element))
            continue
        parts = [c if isinstance(c, str) else texts.pop(id(c)) for c in e.children]
        inner = " ".join(" ".join(parts).split())
        texts[id(e)] = f"<{e.tag}>{inner}" if inner and e.tag not in INLINE else inner
        if inner and e.tag not in INLINE and e.tag not in RAW and e.tag not in ("#root", "html", "body", "head"):
            found[id(e)] = xxh64_intdigest(texts[id(e)]) - (1 << 63)
            texts[id(e)] = f"<{e.tag} {found[id(e)]}>"
    return found


def main_text(page: str | None, frequent: frozenset[int] = frozenset(), inside: frozenset[int] = frozenset()) -> str:
    """The blocks of the article of a page, without subtrees whose hash is in ``frequent`` (``inside`` for those in an article)."""
    if page is None or not page.strip():
        return ""
    root = tree_of(page)
    hashes = hash_subtrees(root) if frequent or inside else {}
    scopes: dict[str, list[list[str]]] = {"article": [], "main": [], "#root": []}
    stack: list = [(root, False, ())]
    # each open scope gathers pieces; None ends a block
    while stack:
        e, in_article, into = stack.pop()
        if e is None or isinstance(e, str):
            for pieces in into:
                pieces.append(e)
            continue
        if unwanted(e, in_article) or hashes.get(id(e)) in (inside if in_article else frequent):
            continue
        scope = scope_of(e)
        if scope in scopes and not (scope == "article" and in_article):
            pieces: list = []
            scopes[scope].append(pieces)
            into = (*into, pieces)
        in_article = in_article or scope in ("article", "main")
        if e.tag == "br":
            stack.append((" ", in_article, into))
            continue
        ends = e.tag not in INLINE
        if ends:
            stack.append((None, in_article, into))
        stack.extend((c, in_article, into) for c in reversed(e.children))
        if ends:
            stack.append((None, in_article, into))
    for scope in ("article", "main", "#root"):
        blocks = [b for pieces in scopes[scope] for b in _blocks(pieces)]
        if blocks:
            return "\n\n".join(blocks)
    return ""


def _blocks(pieces: list) -> Iterator[str]:
    block: list[str] = []
    for piece in [*pieces, None]:
        if piece is not None:
            block.append(piece)
            continue
        if text := " ".join("".join(block).split()):
            yield text
        block = []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1))


def scope_of(e: Element) -> str:
    """``article``, ``main`` or the tag."""
    return "main" if "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", e.attributes) else e.tag


def subtree_cores(root: Element) -> set[tuple[int, bool, int]]:
    """``(subtree, whether it is inside an article, longest block of the page outside it or 0)`` of every subtree hash."""
    hashes = hash_subtrees(root)
    blocks: list[tuple[int, int]] = []  # (-length, hash) in page order
    spans: dict[int, list[tuple[int, int]]] = {}  # per hash the ranges of blocks that it holds
    places: set[tuple[int, bool]] = set()
    stack: list = [(root, False, None)]
    while stack:
        e, inside, began = stack.pop()
        if began is not None:
            spans.setdefault(hashes[id(e)], []).append((began, len(blocks)))
            continue
        if id(e) in hashes:
            places.add((hashes[id(e)], inside))
            stack.append((e, inside, len(blocks)))
            own = sum(len(c.strip()) for c in e.children if isinstance(c, str))
            own += sum(len(c) for k in e.children if isinstance(k, Element) and k.tag in INLINE for c in k.children if isinstance(c, str))
            if own:
                blocks.append((-own, hashes[id(e)]))
        inside = inside or scope_of(e) in ("article", "main")
        stack.extend((c, inside, None) for c in reversed(e.children) if isinstance(c, Element))
    none = (0, 0)
    before = [none, *accumulate(blocks, min)]  # the longest block before, and from, each place
    after = [none, *accumulate(reversed(blocks), min)][::-1]
    core = {}
    for subtree, held in spans.items():
        gaps = zip(held, held[1:])
        between = [min(blocks[end:start], default=none) for (_, end), (start, _) in gaps]
        core[subtree] = min(before[held[0][0]], after[held[-1][1]], *between)[1] if held else 0
    return {(s, inside, core[s]) for s, inside in places}


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = {(h, *found) for h, page in zip(f["host"], f["html"]) for found in subtree_cores(tree_of(page))}
        yield pd.DataFrame(list(rows), columns=["host", "subtree", "inside", "core"])


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        known = [[frozenset() if s is None else frozenset(s.tolist()) for s in f[c]] for c in ("frequent", "inside")]
        texts = [main_text(p, *s) for p, *s in zip(f["html"], *known)]
        yield pd.DataFrame({"page_id": pd.array(f["page_id"], dtype="Int64"), "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, growth: float = GROWTH, share: float = SHARE) -> DataFrame:
    """``(host, frequent, inside)``: per host the hashes of subtrees that stand beside many different blocks."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page_key"), "html").where("host <> '' and html is not null")
    sizes = keyed.groupBy("host").agg(F.count_distinct("page_key").alias("pages")).where(F.col("pages") >= least_pages)
    subtrees = keyed.select("host", "html").mapInPandas(_counted, "host string, subtree long, inside boolean, core long")
    counted = subtrees.groupBy("host", "subtree", "inside").agg(F.count_distinct("core").alias("beside"))
    falling = F.greatest(F.lit(least_pages), F.ceil(F.sqrt("pages") * growth))
    needed = F.when(F.col("inside"), F.greatest(falling, F.ceil(F.col("pages") * share))).otherwise(falling)
    often = counted.where(F.col("beside") >= least_pages).join(sizes, "host").where(F.col("beside") >= needed)
    within = F.col("inside")
    return often.groupBy("host").agg(
        F.collect_list(F.when(~within, F.col("subtree"))).alias("frequent"), F.collect_list(F.when(within, F.col("subtree"))).alias("inside")
    )


def extract_pages(pages: DataFrame, least_pages: int = LEAST_PAGES, growth: float = GROWTH, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    templates = saved(site_templates(pages, least_pages, growth, share), "site-templates")
    held = templates.agg(F.sum(F.size("frequent") + F.size("inside") + F.length("host"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    near = F.broadcast(templates) if held <= BROADCAST_HASHES else templates
    joined = rows.join(near, "host", "left").select("page_id", "url", "html", "frequent", "inside")
    return joined.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")


@query("op8_site_templates")
def op8_site_templates(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
