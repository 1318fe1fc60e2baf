"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A token is an element's place in the page: the tags and classes from the root
down.  Its occurrence vector counts it on each page of the host.  Tokens with
one vector form a class; a vector is kept as a sum of hashes of (page, count),
so Spark adds it up with partial aggregation and a host may have any number of
pages.  A class counts if it has two tokens or more that occur once on each of
its pages, on at least half of the host's, and is valid if all tokens above its
own belong to such classes too: valid classes nest into the host's template.  Everything else hangs in the slots of
the template, and text is counted to the innermost valid token above it.  The
slot with most text that is not a link, outside of menus, adverts and the like,
is the host's main slot.  Of a page the blocks below its main slot are
extracted, and with them the other slots of the element that holds it, such as
title and lead, if that is not the body and they are not mostly links; of
articles, all.  Hosts with fewer than MIN_PAGES pages share one template.

Names carry what vectors can't: an article or main element outweighs any
amount of text, and menus, headers, footers, sidebars, notices, adverts, forms
and comments are known by tag, role, or the first or last word of a class or id
wherever they are; a page without other text is read without these names.  A
page that has none of its host's slots is read from its own article, or else
its body.

Defined results: null or empty html gives an empty text; pages without a host
share one; equal page ids are pages of their own; broken and cut markup is read
as far as it goes; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table

# Elements nested deeper count as part of the one above, as browsers do at a like depth; their text stays.
DEPTH = 256
# Hosts with fewer pages share a template.
MIN_PAGES = 3
# Their pool; no host has this name.
SHARED = "*"
# An article outweighs any amount of text.
ARTICLE_SCORE = 1e300

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup td th time tt u var wbr".split()
)
_SPACED = frozenset("br td th img".split())  # inline, but apart
# An element of these closes an open one of the listed.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
# Nothing is closed beyond these.
_SCOPE = frozenset("html body article section main div table ul ol dl aside nav header footer form blockquote td th".split())
_DROPPED_TAGS = frozenset("head nav footer aside form button select option menu dialog svg canvas template object audio video map fieldset".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended widget comment comments commentlist reply replies respond disqus pagination pager toolbar "
    "search form skip".split()
)
# These are never dropped by name: their names tell of the page or of the text below.
_KEPT_TAGS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
# A name with one of these tells what a layout has or lacks: no-sidebar, comments-open.
_STATES = frozenset("no not without has have with hide show is open opened closed enabled disabled".split())


class Page:
    """Elements and text blocks of a page in order."""

    def __init__(self) -> None:
        # Per element: its parent, its place as a hash, whether it is dropped, whether it is an article.
        self.parent: list[int] = [-1]
        self.place: list[int] = [0]
        self.dropped: list[bool] = [False]
        self.article: list[bool] = [False]
        # Whether it is the page, html or body.
        self.whole: list[bool] = [True]
        # (element, text, code points in links) of each block.
        self.blocks: list[tuple[int, str, int]] = []


_places: dict[tuple[int, str, str], int] = {}


def _place(parent: int, tag: str, names: str) -> int:
    key = (parent, tag, names)
    place = _places.get(key)
    if place is None:
        if len(_places) > 100_000:
            _places.clear()
        raw = xxhash.xxh64_intdigest(f"{parent}/{tag}.{names}")
        place = _places[key] = raw - (1 << 64) if raw >> 63 else raw
    return place


def _is_dropped(tag: str, role: str, inside_article: bool) -> bool:
    return tag in _DROPPED_TAGS or role.lower() in _DROPPED_ROLES or tag == "header" and not inside_article


def _is_named(tag: str, names: str, inside_article: bool) -> bool:
    """Whether a class or id begins or ends with a listed word."""
    if tag in _KEPT_TAGS:
        return False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        ends = {*words[:1], *words[-1:]}
        if (ends & _DROPPED_NAMES or "header" in ends and not inside_article) and not _STATES & set(words):
            return True
    return False


def parse(source: str, by_name: bool = True) -> Page:
    """``by_name``: whether blocks are dropped by class and id."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    block_element, link_chars, links = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((block_element, text, link_chars))
            pieces.clear()
        link_chars = 0

    def close(index: int) -> None:
        """Close all elements from this one of the stack on."""
        nonlocal links
        for tag, _ in stack[index:]:
            links -= tag == "a"
            if tag not in _INLINE:
                flush()
        del stack[index:]

    def say(text: str) -> None:
        nonlocal block_element, link_chars
        element = stack[-1][1]
        if not page.dropped[element]:
            if not pieces:
                block_element = element
            pieces.append(text)
            if links:
                link_chars += len(text)

    at, end = 0, len(source)
    while at < end:
        m = _MARKUP.search(source, at)
        upto = m.start() if m else end
        if upto > at:
            say(source[at:upto])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in _SPACED:
                say(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag not in _INLINE:
                    flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            ending = _RAW_END[tag].search(source, at)
            at = ending.end() if ending else end
            continue
        if tag not in _INLINE:
            # A block closes an open paragraph, with all that is open inside.
            shut = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in shut:
                    close(i)
                    if tag not in _CLOSES:
                        break
                elif stack[i][0] in _SCOPE:
                    break
            flush()
        elif tag in _SPACED:
            say(" ")
        if tag in _VOID:
            continue
        names = role = ""
        if "=" in attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if name.lower() == "role":
                    role = value
                else:
                    names += (" " if names else "") + value
        parent = stack[-1][1]
        inside = page.article[parent]
        dropped = page.dropped[parent] or _is_dropped(tag, role, inside) or by_name and tag not in _INLINE and _is_named(tag, names, inside)
        if dropped == page.dropped[parent] and (tag in _INLINE or len(stack) > DEPTH):
            element = parent
        else:
            element = len(page.parent)
            page.parent.append(parent)
            page.place.append(_place(page.place[parent], tag, names))
            page.dropped.append(dropped)
            page.whole.append(tag in ("html", "body"))
            page.article.append(inside or tag in ("article", "main") or role == "main")
        stack.append((tag, element))
        links += tag == "a"
    flush()
    return page


def host_of(url):
    """The host of a url column, lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1), F.lit("")))


OUTLINE = "row long, place long, above array<long>, count long, chars long, linked long, article boolean, dropped boolean"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and token: how often it occurs, the tokens above it and its text outside of and in links."""
    for batch in batches:
        for lo, hi in slices(batch.column("html")):
            rows = []
            for row, source in zip(batch.column("row")[lo:hi].to_pylist(), batch.column("html")[lo:hi], strict=True):
                page = parse(source.as_py())
                found: dict[int, list] = {}
                for e, place in enumerate(page.place):
                    if place in found:
                        found[place][3] += 1
                    else:
                        above, up = [], page.parent[e]
                        while up >= 0:
                            above.append(page.place[up])
                            up = page.parent[up]
                        own = page.article[e] and (e == 0 or not page.article[page.parent[e]])
                        found[place] = [row, place, above, 1, 0, 0, own, page.dropped[e]]
                for element, text, linked in page.blocks:
                    found[page.place[element]][4] += max(len(text) - linked, 0)
                    found[page.place[element]][5] += min(len(text), linked)
                rows += found.values()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "place", "above", "count", "chars", "linked", "article", "dropped"]
            )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column("html")):
            texts = []
            for source, slots in zip(batch.column("html")[lo:hi], batch.column("slots")[lo:hi], strict=True):
                html, known = source.as_py(), slots.as_py() or ()
                scores, links = {s["place"]: s["score"] for s in known}, {s["place"] for s in known if s["links"]}
                # What is dropped by name is the text of a page that has no other.
                texts.append(main_text(parse(html), scores, links) or main_text(parse(html, by_name=False), scores, links))
            yield pa.RecordBatch.from_arrays([batch.column("carried")[lo:hi], pa.array(texts, pa.string())], ["carried", "text"])


def main_text(page: Page, slots: dict[int, float], links: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks below the best of the slots that the page has, and of its container's other slots but those of links."""
    there = [(slots.get(place, 0.0), -e) for e, place in enumerate(page.place) if not page.dropped[e]]
    score, best = max(there)
    if score >= ARTICLE_SCORE:
        places, container = {place for place in page.place if slots.get(place) == score}, 0
    else:
        places, container = {page.place[-best]}, page.parent[-best]
    beside = container > 0 and score > 0 and not page.whole[container]
    main = [False] * len(page.parent)
    under, linked = [False] * len(page.parent), [False] * len(page.parent)
    for e, up in enumerate(page.parent):
        main[e] = up >= 0 and main[up] or (page.place[e] in places if score > 0 else page.article[e])
        if beside:
            under[e] = e == container or up >= 0 and under[up]
            linked[e] = page.place[e] in links if page.place[e] in slots else up >= 0 and linked[up]
    if beside:
        main = [m or u and not n for m, u, n in zip(main, under, linked, strict=True)]
    if not any(main[e] for e, _, _ in page.blocks):
        main = [True] * len(page.parent)
    return "\n".join(text for e, text, _ in page.blocks if main[e])


def templates(outline: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host its slots with their scores; hosts with few pages share those of their pool.

    A template has no more tokens than two of its pages together.
    """
    vector = F.sum(F.xxhash64("row", "count").cast("decimal(20,0)"))
    tokens = stored(
        outline.groupBy("host", "place").agg(
            F.first("above").alias("above"),
            vector.alias("vector"),
            F.count(F.lit(1)).alias("pages"),
            F.max("count").alias("most"),
            F.sum("chars").alias("chars"),
            F.sum("linked").alias("linked"),
            F.max("article").alias("article"),
            F.max("dropped").alias("dropped"),
        ),
        "host-tokens",
    )
    hosts = tokens.where("place = 0").select("host", F.when(F.col("pages") >= min_pages, F.col("host")).otherwise(SHARED).alias("pool"))
    grouped = stored(
        tokens.join(hosts, "host")
        .groupBy("pool", "place")
        .agg(
            F.first("above").alias("above"),
            F.sum("vector").alias("vector"),
            F.sum("pages").alias("pages"),
            F.max("most").alias("most"),
            F.sum("chars").alias("chars"),
            F.sum("linked").alias("linked"),
            F.max("article").alias("article"),
            F.max("dropped").alias("dropped"),
        ),
        "tokens",
    )
    whole = grouped.where("place = 0").select("pool", F.col("pages").alias("all"))
    # Tokens of one vector are a class; it takes two tokens, once a page, on half of the pages.
    frequent = stored(grouped.join(whole, "pool").where("most = 1 and 2 * pages >= all").drop("all", "chars", "linked"), "frequent")
    large = frequent.groupBy("pool", "vector").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(frequent.join(large, ["pool", "vector"], "left_semi"), "classes")
    # Classes nest: all tokens above a class's tokens, at most as many as a page is deep, belong to large classes.
    named = members.select("pool", F.col("place").alias("up"), F.lit(True).alias("held"))
    broken = (
        members.select("pool", "vector", F.explode("above").alias("up"))
        .join(named, ["pool", "up"], "left")
        .where("held is null and up <> 0")  # 0 is the page itself
        .select("pool", "vector")
    )
    valid = stored(
        members.join(broken, ["pool", "vector"], "left_anti").select("pool", "place", "article", "dropped", F.size("above").alias("depth")), "valid"
    )
    # Text goes to the innermost valid token at or above its place.
    lines = grouped.where("chars + linked > 0 and not dropped").select(
        "pool", F.col("place").alias("line"), "chars", "linked", F.explode(F.concat(F.array("place"), "above")).alias("place")
    )
    slot = (
        lines.join(valid, ["pool", "place"])
        .groupBy("pool", "line")
        .agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.max(F.struct("depth", "place", "dropped")).alias("slot"))
        .where("not slot.dropped")
        .groupBy("pool", F.col("slot.place").alias("place"))
        .agg(F.sum("chars").cast("double").alias("score"), F.sum("linked").cast("double").alias("linked"))
    )
    articles = valid.where("article and not dropped").select("pool", "place", F.lit(ARTICLE_SCORE).alias("score"), F.lit(0.0).alias("linked"))
    best = slot.unionByName(articles).groupBy("pool", "place").agg(F.max("score").alias("score"), F.max("linked").alias("linked"))
    slots = stored(best.groupBy("pool").agg(F.collect_list(F.struct("place", "score", (F.col("linked") > F.col("score")).alias("links"))).alias("slots")), "templates")
    return hosts.join(slots, "pool", "left").select("host", "slots")


def extract_pages(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Per page: carried, a struct of the columns ``carry`` (all but the html by default), and text, its main text."""
    carry = [c for c in pages.columns if c != html_col] if carry is None else carry
    rows = pages.select(
        F.struct(*(F.col(c) for c in carry)).alias("carried"),
        F.monotonically_increasing_id().alias("row"),
        host_of(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    outline = rows.select("host", "row", "html").mapInArrow(_hosted, "host string, " + OUTLINE)
    template = stored(templates(outline, min_pages), "host-templates")
    joined = rows.join(template.hint("merge"), "host", "left")
    return joined.select("carried", "html", "slots").mapInArrow(_extract, f"carried {rows.schema['carried'].dataType.simpleString()}, text string")


def _hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outline with each page's host; a page's rows are consecutive."""
    for batch in batches:
        hosts = dict(zip(batch.column("row").to_pylist(), batch.column("host").to_pylist(), strict=True))
        for part in _outline(iter([batch])):
            named = pa.array([hosts[r] for r in part.column("row").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([named, *part.columns], ["host", *part.schema.names])


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("carried.page_id", "carried.url", "text", F.length("text").cast("long").alias("n_chars"))
