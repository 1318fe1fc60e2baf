"""Resolving what pages refer to: users, page titles, child lists, includes and attachments.

References leave the page bodies as thin rows ``(id, kind, key)``, are joined
with their dimension tables, and come back as one array per page.  Bodies are
scanned once to find the references and once, with one join, to convert them.
A key referred to by very many pages is split (:mod:`wikitables.plans.skew`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.regex import apply_rules, extract, extract_all, matches, replace_all, trim_ws
from ..functions.text import (
    child_link, decode_uri, encode_uri, front_matter, let, page_url, simple_name, slugify50, unslugify,
)
from ..plans.ranking import ranked
from ..plans.skew import spread_join
from ..plans.storage import store
from . import markdown as M
from .tree import child_pages

# Pieces that one task joins before the parts of a text are joined.
PART = 1000

REF = "array<struct<kind string, key string, value string>>"


@dataclass(frozen=True)
class MarkdownOptions:
    base_url: str = ""
    resolved_links: bool = False


# ---- dimensions -----------------------------------------------------------------


def first_by_title(index: DataFrame) -> DataFrame:
    """One page per title, the first in listing order."""
    return index.groupBy("title").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))


def page_by_title(index: DataFrame, refs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Look titles up: ``refs`` plus ``target_id``, null when no page has the title.

    ``refs`` has ``id`` and ``title``; ``overrides(title, id)`` wins over the index.
    """
    titles = first_by_title(index)
    if overrides is not None:
        titles = titles.join(overrides, "title", "left_anti").unionByName(overrides.select("title", "id"))
    return spread_join(refs, titles.withColumnRenamed("id", "target_id"), ["title"])


def user_labels(users: DataFrame) -> DataFrame:
    """Users by both kinds of key, one label each: ``(kind, key, label)``."""
    label = F.coalesce("display_name", "username")
    by_name = users.select(F.lit("username").alias("kind"), F.col("username").alias("key"), label.alias("label"))
    by_key = users.select(F.lit("userkey").alias("kind"), F.col("user_key").alias("key"), label.alias("label"))
    return by_name.unionByName(by_key).dropna(subset=["key"]).groupBy("kind", "key").agg(F.min("label").alias("label"))


def distinct_users(refs: DataFrame) -> DataFrame:
    """Each referenced user once."""
    return refs.where(F.col("kind").isin("username", "userkey")).select("kind", "key").distinct()


def resolve_users(refs: DataFrame, users: DataFrame) -> DataFrame:
    """``refs(id, kind, key)`` with the text each user reference becomes."""
    handle = F.when(F.col("kind") == "username", F.col("key")).otherwise(
        F.concat(F.lit("user-"), F.right(F.col("key"), F.lit(8)))
    )
    return (
        spread_join(refs, user_labels(users), ["kind", "key"])
        .withColumn("label", F.concat(F.lit("@"), F.coalesce(F.col("label"), handle)))
    )


def assemble_page(pieces: DataFrame, sep: str, size: int = PART) -> DataFrame:
    """Join the ordered pieces ``(id, pos, s)`` of each text: ``(id, text)``.

    Runs of ``size`` pieces are joined first, so a text of very many pieces is
    joined by many tasks, and its last task sees a part of the rows.
    """
    numbered = ranked(pieces, ["pos"], "_rank", ["id"])
    parts = (
        numbered.groupBy("id", F.expr(f"(_rank - 1) div {size}").alias("_part"))
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "s"))).alias("_pieces"))
        .select("id", "_part", F.array_join(F.transform("_pieces", lambda p: p["s"]), sep).alias("_text"))
    )
    return parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_part", "_text"))).alias("_parts")).select(
        "id", F.array_join(F.transform("_parts", lambda p: p["_text"]), sep).alias("text")
    )


def child_lists(index: DataFrame, parents: DataFrame | None = None, size: int = PART) -> DataFrame:
    """The child list of each parent, or of the given ones: ``(parent_id, list)``."""
    children = index.where(F.col("parent_id").isNotNull()).select("parent_id", "pos", "id", "title")
    if parents is not None:
        children = child_pages(children, parents)
    lines = children.select(
        F.col("parent_id").alias("id"), F.struct("pos", "id").alias("pos"), child_link(F.col("title")).alias("s")
    )
    return assemble_page(lines, "\n", size).select(F.col("id").alias("parent_id"), F.concat("text", F.lit("\n\n")).alias("list"))


# ---- references of the pages ------------------------------------------------------


def _lookup_pattern(options: MarkdownOptions) -> str:
    pattern = r'<ri:user|ac:name="(?:children|list-children|include)"'
    return pattern + "|<ri:page" if options.resolved_links else pattern


def page_refs(pages: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """The distinct references of each page: ``(id, kind, key)``.

    ``kind`` is username, userkey, children, include, link, or self for the
    page's own child list.
    """
    nothing = F.create_map().cast("map<string,string>")
    hit = pages.where(matches(F.col("html"), _lookup_pattern(options), "i")).select(
        "id", M.flatten_cell_lists(M.normalize_newlines(F.col("html"))).alias("html")
    )
    html = F.col("html")
    staged = hit.withColumn(
        "rest", M.expand_list_children(M.expand_children(html, nothing, F.lit("")), F.lit(""))
    )

    def keys(kind: str, found: Column) -> Column:
        return F.transform(found, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    children = F.transform(extract_all(html, R.CHILDREN_MACRO, 0, "i"), M.macro_title)
    includes = F.transform(extract_all(F.col("rest"), R.INCLUDE_MACRO, 0, "i"), M.macro_title)
    own = F.when(matches(html, r'ac:name="(?:children|list-children)"', "i"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    found = [
        keys("username", extract_all(html, R.USERNAME_LINK, 1, "i")),
        keys("userkey", extract_all(html, R.USERKEY_LINK, 1, "i")),
        keys("children", F.filter(children, lambda t: t != "")),
        keys("include", F.filter(includes, lambda t: t != "")),
        keys("self", own),
    ]
    if options.resolved_links:
        found.append(keys("link", extract_all(html, R.BARE_PAGE_LINK, 1, "i")))
    # The outer form, because a plain explode would also filter on its input and so extract everything twice.
    exploded = staged.select("id", F.explode_outer(F.array_distinct(F.concat(*found))).alias("ref"))
    return exploded.where(F.col("ref").isNotNull()).select("id", "ref.*")


def _title_targets(refs: DataFrame, index: DataFrame, overrides: DataFrame | None) -> DataFrame:
    titled = refs.where(F.col("kind").isin("children", "include", "link")).withColumnRenamed("key", "title")
    return page_by_title(index, titled, overrides).where(F.col("target_id").isNotNull())


def resolve_children(refs: DataFrame, targets: DataFrame, index: DataFrame) -> DataFrame:
    """Values of the child list references, titled ones and the pages' own."""
    listed = targets.where(F.col("kind") == "children").select(F.col("target_id").alias("id")).unionByName(
        refs.where(F.col("kind") == "self").select("id")
    )
    titled = targets.where(F.col("kind") == "children").select("id", "kind", F.col("title").alias("key"), "target_id")
    own = refs.where(F.col("kind") == "self").select("id", "kind", "key", F.col("id").alias("target_id"))
    lists = child_lists(index, listed).withColumnRenamed("parent_id", "target_id")
    value = F.coalesce(F.col("list"), F.when(F.col("kind") == "children", F.lit(R.NO_CHILDREN)))
    return (
        spread_join(titled.unionByName(own), lists, ["target_id"])
        .select("id", "kind", "key", value.alias("value"))
        .where(F.col("value").isNotNull())
    )


def include_items(html: Column) -> Column:
    """Bullet lines an included page contributes: its first list, else its links, else nothing."""

    def item(inner: Column) -> Column:
        linked = apply_rules(trim_ws(inner), R.ANCHOR_RULES)
        return F.concat(F.lit("- "), trim_ws(replace_all(linked, R.ANY_TAG, "")))

    def anchor(tag: Column) -> Column:
        text = trim_ws(replace_all(extract(tag, R.ANCHOR, 2, "i"), R.ANY_TAG, ""))
        return F.concat(F.lit("- ["), text, F.lit("]("), extract(tag, R.ANCHOR, 1, "i"), F.lit(")"))

    def items(x: Column) -> Column:
        listed = F.transform(extract_all(extract(x, R.FIRST_LIST, 1, "i"), R.LIST_ITEM, 1, "i"), item)
        return F.when(F.size(listed) > 0, listed).otherwise(F.transform(extract_all(x, R.ANCHOR, 0, "i"), anchor))

    return let(html, items)


def include_text(title: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n## "), title, F.lit("\n\n"), text, F.lit("\n\n"))


def resolve_includes(
    targets: DataFrame, pages: DataFrame, rows: DataFrame, options: MarkdownOptions = MarkdownOptions()
) -> DataFrame:
    """Values of the include references.  Includes expand one level; a page never includes itself.

    A page with neither a list nor links is included as its own Markdown, for
    which ``rows`` holds the other resolved references.
    """
    wanted = targets.where((F.col("kind") == "include") & (F.col("id") != F.col("target_id"))).select(
        "id", "title", "target_id"
    )
    ids = wanted.select(F.col("target_id").alias("id")).distinct()
    bodies = store(
        pages.join(ids, "id", "left_semi")
        .where(F.col("html") != "")
        .select("id", "title", "html", include_items(M.normalize_newlines(F.col("html"))).alias("items")),
        "include-bodies",
    )
    listed = bodies.where(F.size("items") > 0).select(
        F.col("id").alias("target_id"), F.array_join("items", "\n").alias("text")
    )
    whole = bodies.where(F.size("items") == 0).select("id", "title", "html")
    texts = listed
    if not whole.isEmpty():
        converted = convert_pages(whole, rows.where(F.col("kind") != "include"), options)
        texts = listed.unionByName(converted.select(F.col("id").alias("target_id"), F.col("html").alias("text")))
    return spread_join(wanted, texts, ["target_id"], "inner").select(
        "id", F.lit("include").alias("kind"), F.col("title").alias("key"), include_text(F.col("title"), F.col("text")).alias("value")
    )


# Given page ids, the stored bodies of these pages: ``(id, title, html)``.
Bodies = Callable[[DataFrame], DataFrame]


def resolve_refs(
    pages: DataFrame,
    index: DataFrame,
    users: DataFrame,
    options: MarkdownOptions = MarkdownOptions(),
    overrides: DataFrame | None = None,
    bodies: Bodies | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """All resolved references ``(id, kind, key, value)``.

    Included pages are looked for in ``pages`` and, where ``bodies`` is given,
    among the stored ones; these bring references of their own, which are
    resolved with the others.  ``found`` are the stored :func:`page_refs` of
    ``pages``.
    """
    refs = store(page_refs(pages, options), "refs") if found is None else found
    targets = store(_title_targets(refs, index, overrides), "targets")
    includes = targets.where(F.col("kind") == "include")
    if bodies is not None and not includes.isEmpty():
        missing = includes.select(F.col("target_id").alias("id")).distinct().join(pages.select("id"), "id", "left_anti")
        outside = store(bodies(store(missing, "include-targets")), "outside-bodies")
        theirs = store(page_refs(outside, options).where(F.col("kind") != "include"), "outside-refs")
        refs = refs.unionByName(theirs)
        targets = store(targets.unionByName(_title_targets(theirs, index, overrides)), "all-targets")
        pages = pages.select("id", "title", "html").unionByName(outside.select("id", "title", "html"))
    user_refs = refs.where(F.col("kind").isin("username", "userkey"))
    user_rows = resolve_users(user_refs, users).select(
        "id", "kind", "key", F.substring("label", 2, 1 << 30).alias("value")
    )
    rows = user_rows.unionByName(resolve_children(refs, targets, index))
    if options.resolved_links:
        rows = rows.unionByName(_link_rows(targets.where(F.col("kind") == "link"), index))
    rows = store(rows, "resolved")
    if targets.where(F.col("kind") == "include").isEmpty():
        return rows
    return rows.unionByName(store(resolve_includes(targets, pages, rows, options), "included"))


def _link_rows(links: DataFrame, index: DataFrame) -> DataFrame:
    """Values of the page links: the file each target is really stored under."""
    name = F.concat(F.col("id"), F.lit("-"), slugify50(F.col("title")), F.lit(".md"))
    files = index.select(F.col("id").alias("target_id"), name.alias("value"))
    return spread_join(links, files, ["target_id"], "inner").select("id", "kind", F.col("title").alias("key"), "value")


# ---- upkeep: which pages a change concerns -------------------------------------------


def kept_references(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """The references of each page to keep beside its Markdown, ``(id, kind, key)``; a page without any has a row without kind."""
    return pages.select("id").join(refs.select("id", "kind", "key"), "id", "left")


def including_pages(refs: DataFrame, index: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of the pages that include one of the ``changed`` pages."""
    titled = refs.where(F.col("kind") == "include").select("id", F.col("key").alias("title"))
    targets = page_by_title(index, titled).select("id", F.col("target_id"))
    return spread_join(targets, changed.select(F.col("id").alias("target_id")).distinct(), ["target_id"], "left_semi").select("id").distinct()


def changed_titles(before: DataFrame, now: DataFrame) -> DataFrame:
    """Titles that lead to another page than before, or to one or none only now."""
    old, new = (first_by_title(i) for i in (before, now))
    both = old.withColumnRenamed("id", "_old").join(new.withColumnRenamed("id", "_new"), "title", "full_outer")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("title")


def _list_digests(index: DataFrame) -> DataFrame:
    """Per parent a digest of its child list: the sum of hashes of each child's place and title, partly summed before the shuffle."""
    children = index.where(F.col("parent_id").isNotNull()).select("parent_id", "pos", "id", "title")
    placed = ranked(children, ["pos", "id"], "_rank", ["parent_id"])
    digest = F.sum(F.xxhash64("_rank", "title").cast("decimal(20,0)")).alias("digest")
    return placed.groupBy(F.col("parent_id").alias("id")).agg(digest)


def changed_lists(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pages whose child list is not what it was."""
    old, new = (_list_digests(i) for i in (before, now))
    both = old.withColumnRenamed("digest", "_old").join(new.withColumnRenamed("digest", "_new"), "id", "full_outer")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("id")


def concerned_pages(refs: DataFrame, before: DataFrame, now: DataFrame, fetched: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """Ids of the pages whose Markdown a change of the index or of bodies may touch: a superset of those it does touch.

    ``refs`` are the references kept of all pages, ``fetched`` the pages with a
    new body.  The first step finds the pages whose own text changes: they were
    fetched or renamed, list the children of a page whose list changed, or name
    a title that leads elsewhere.  Includes expand one level, so the second
    step, to the pages that include one of these, is the last.
    """
    titles, lists = store(changed_titles(before, now), "changed-titles"), store(changed_lists(before, now), "changed-lists")
    titled = refs.where(F.col("kind").isin("children", "include", "link")).select("id", "kind", F.col("key").alias("title"))
    elsewhere = spread_join(titled, titles, ["title"], "left_semi").select("id", "kind")
    own_lists = refs.where(F.col("kind") == "self").select("id").join(lists, "id", "left_semi")
    listing = page_by_title(now, titled.where(F.col("kind") == "children").select("id", "title")).select("id", "target_id")
    listing = spread_join(listing, lists.withColumnRenamed("id", "target_id"), ["target_id"], "left_semi").select("id")
    renamed = now.select("id", "title").join(before.select("id", F.col("title").alias("_was")), "id").where(~F.col("title").eqNullSafe(F.col("_was")))
    first = fetched.select("id").unionByName(elsewhere.where(F.col("kind") != "include").select("id")).unionByName(own_lists).unionByName(listing)
    first = store(first.unionByName(renamed.select("id")).distinct(), "changed-pages")
    second = including_pages(refs, now, first).unionByName(elsewhere.where(F.col("kind") == "include").select("id"))
    found = first.unionByName(second)
    if options.resolved_links:  # a link holds the name of its target's file
        links = page_by_title(now, titled.where(F.col("kind") == "link").select("id", "title")).select("id", "target_id")
        linking = store(spread_join(links, renamed.select(F.col("id").alias("target_id")), ["target_id"], "left_semi").select("id").distinct(), "linking-pages")
        found = found.unionByName(linking).unionByName(including_pages(refs, now, linking))
    return found.distinct()


# ---- conversion --------------------------------------------------------------------


def _of_kind(refs: Column, kind: str) -> Column:
    return F.map_from_entries(
        F.transform(F.filter(refs, lambda r: r["kind"] == kind), lambda r: F.struct(r["key"], r["value"]))
    )


def with_refs(pages: DataFrame, rows: DataFrame, escaped: bool = False) -> DataFrame:
    """Pages with their resolved references in ``refs``: one scan of the bodies, and one shuffle unless the references are few.

    ``escaped`` escapes keys and values as the page texts are (see :func:`M.escape_fences`).
    """
    fields = [M.escape_fences(F.col(c)).alias(c) if escaped else F.col(c) for c in ("key", "value")]
    found = rows.groupBy("id").agg(F.collect_set(F.struct("kind", *fields)).alias("refs"))
    return pages.join(found, "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast(REF)))


def insert_refs(df: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """Cell lists, macros, user links and page links of ``html``, from the references in ``refs``.

    Adds ``includes``, the texts to fill in after the table stage.
    """
    bound = F.struct(
        M.flatten_cell_lists(M.escape_fences(M.normalize_newlines(F.col("html")))).alias("html"),
        *(_of_kind(F.col("refs"), kind).alias(kind) for kind in ("username", "userkey", "children", "self", "include", "link")),
    )

    def chain(v: Column) -> Column:
        own = F.try_element_at(v["self"], F.lit(""))
        text = M.expand_children(v["html"], v["children"], own)
        text = M.expand_list_children(text, own)
        text = M.mark_includes(text, v["include"])
        text = M.convert_macros(M.unwrap_tables(text))
        text = M.link_users(text, v["username"], v["userkey"])
        return M.link_pages(text, v["link"] if options.resolved_links else None)

    return df.withColumns({"html": let(bound, chain), "includes": _of_kind(F.col("refs"), "include")}).drop("refs")


def convert_pages(pages: DataFrame, rows: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """Markdown bodies in ``html`` and image references in ``images``."""
    staged = insert_refs(with_refs(pages, rows, escaped=True), options)
    staged = staged.withColumns(
        {"html": M.link_images(F.col("html")), "images": M.image_refs(F.col("html"), F.col("id"), M.unescape_fences)}
    )
    return M.convert_plain(staged, "html", F.col("includes")).drop("includes").withColumn("html", M.unescape_fences(F.col("html")))


def pages_to_markdown(
    pages: DataFrame,
    index: DataFrame,
    users: DataFrame,
    options: MarkdownOptions = MarkdownOptions(),
    overrides: DataFrame | None = None,
    bodies: Bodies | None = None,
    found: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Markdown of the given pages: ``(id, file, markdown, images)``, one row per page.

    ``pages`` has ``id, title, html``; ``index`` has ``pos, id, title,
    parent_id`` of every page of the space.  Where ``pages`` are not the whole
    corpus, ``bodies`` looks included pages up, see :func:`resolve_refs`.
    ``tasks`` deals the bodies to so many tasks first, for input files of few
    splits.
    """
    plain = pages.select("id", "title", "html")
    plain = plain.repartition(tasks) if tasks else plain
    converted = convert_pages(plain, resolve_refs(plain, index, users, options, overrides, bodies, found), options)
    name = F.concat(F.col("id"), F.lit("-"), slugify50(F.col("title")))
    head = F.concat(
        front_matter(unslugify(name), F.col("id"), page_url(options.base_url, F.col("id"))), F.lit("\n\n")
    )
    return converted.select(
        "id", F.concat(name, F.lit(".md")).alias("file"), M.final_unescape(F.concat(head, F.col("html"))).alias("markdown"), "images"
    )


# ---- attachments --------------------------------------------------------------------


def image_manifest(converted: DataFrame) -> DataFrame:
    """One row per image reference: ``(page_id, pos, kind, container_id, name, slug_name)``."""
    exploded = converted.select(F.col("id").alias("page_id"), F.posexplode_outer("images").alias("pos", "image"))
    return exploded.where(F.col("image").isNotNull()).select(
        "page_id", "pos", "image.*", M.image_file(F.col("image.name")).alias("slug_name")
    )


def attachment_candidates(kind: Column, name: Column) -> Column:
    """The file names to try for an image, in order.

    An inline name that cannot be decoded ends the search after the first try.
    """
    simple = simple_name(name)
    decoded = decode_uri(name)
    others = F.array_compact(
        F.array(
            F.when(decoded != name, decoded),
            F.when((simple != "") & (simple != name), simple),
        )
    )
    inline = F.when(decoded.isNull(), F.array(name)).otherwise(F.concat(F.array(name), others))
    return F.when(kind == "storage", F.array(name, encode_uri(name))).otherwise(inline)


def resolve_attachments(manifest: DataFrame, attachments: DataFrame) -> DataFrame:
    """The manifest with ``filename``, ``content`` and ``found``; unresolved references stay, with ``found`` false.

    The search runs on names alone; contents move once, to the winners.
    """
    tried = store(
        manifest.select(
            "page_id", "pos", "container_id",
            F.posexplode(attachment_candidates(F.col("kind"), F.col("name"))).alias("_try", "filename"),
        ),
        "attachment-tries",
    )
    files = attachments.withColumnRenamed("page_id", "container_id")
    hits = spread_join(
        tried, files.select("container_id", "filename"), ["container_id", "filename"], "left_semi"
    )
    won = hits.groupBy("page_id", "pos").agg(F.min_by("filename", "_try").alias("filename"))
    named = store(manifest.join(won, ["page_id", "pos"], "left"), "attachment-names")
    return spread_join(named, files, ["container_id", "filename"]).withColumn(
        "found", F.col("filename").isNotNull()
    )


# ---- single stages over whole tables ------------------------------------------------------


def expand_children(pages: DataFrame, index: DataFrame) -> DataFrame:
    """``(id, html)`` with the ``children`` macros expanded."""
    return _with_children(
        pages, index, lambda html, refs: M.expand_children(html, _of_kind(refs, "children"), _own_list(refs))
    )


def expand_list_children(pages: DataFrame, index: DataFrame) -> DataFrame:
    """``(id, html)`` with the ``list-children`` macros expanded."""
    return _with_children(pages, index, lambda html, refs: M.expand_list_children(html, _own_list(refs)))


def _own_list(refs: Column) -> Column:
    return F.try_element_at(_of_kind(refs, "self"), F.lit(""))


def _with_children(pages: DataFrame, index: DataFrame, stage) -> DataFrame:
    refs = store(page_refs(pages), "refs")
    targets = store(_title_targets(refs, index, None), "targets")
    rows = store(resolve_children(refs, targets, index), "resolved")
    return with_refs(pages.select("id", "html"), rows).select("id", stage(F.col("html"), F.col("refs")).alias("html"))


def expand_includes(pages: DataFrame, index: DataFrame, users: DataFrame) -> DataFrame:
    """``(id, html)`` with the ``include`` macros replaced by what they include."""
    rows = resolve_refs(pages, index, users).where(F.col("kind") == "include")

    def stage(html: Column, known: Column) -> Column:
        marked = let(known, lambda k: M.fill_includes(M.mark_includes(M.escape_fences(html), k), k))
        return M.unescape_fences(marked)

    return with_refs(pages.select("id", "html"), rows).select(
        "id", stage(F.col("html"), _of_kind(F.col("refs"), "include")).alias("html")
    )


def link_users(pages: DataFrame, users: DataFrame) -> DataFrame:
    """``(id, html)`` with user references resolved."""
    refs = store(page_refs(pages).where(F.col("kind").isin("username", "userkey")), "refs")
    rows = store(resolve_users(refs, users).select("id", "kind", "key", F.substring("label", 2, 1 << 30).alias("value")), "resolved")
    return with_refs(pages.select("id", "html"), rows).select(
        "id", M.link_users(F.col("html"), _of_kind(F.col("refs"), "username"), _of_kind(F.col("refs"), "userkey")).alias("html")
    )


def link_pages(pages: DataFrame, index: DataFrame, resolved: bool = False) -> DataFrame:
    """``(id, html)`` with page links as Markdown links; ``resolved`` points them at the real files."""
    if not resolved:
        return pages.select("id", M.link_pages(F.col("html")).alias("html"))
    options = MarkdownOptions(resolved_links=True)
    refs = store(page_refs(pages, options), "refs")
    links = store(_title_targets(refs, index, None).where(F.col("kind") == "link"), "targets")
    rows = store(_link_rows(links, index), "resolved")
    return with_refs(pages.select("id", "html"), rows).select(
        "id", M.link_pages(F.col("html"), _of_kind(F.col("refs"), "link")).alias("html")
    )


def match_ordinal(pages: DataFrame, pattern: str, group: int = 1, flags: str = "i") -> DataFrame:
    """Every match of a pattern with its number within the page: ``(id, ordinal, text)``."""
    return pages.select("id", F.posexplode(extract_all(F.col("html"), pattern, group, flags)).alias("ordinal", "text"))
