"""The page forest: parents, roots, preorder, paths and the site tree.

A forest is an adjacency list with one row per reachable page and the values of
all its ancestors in arrays, root first.  It is built by pointer doubling, so a
chain of depth d takes about log2(d) joins; arrays are stored in blocks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import page_filename, slugify50, yaml_quote
from ..plans.ranking import ranked
from ..plans.skew import spread_join
from ..plans.storage import store
from .index_ops import dedupe_by_id

# Levels that stored arrays of ancestors span, a power of two.
BLOCK = 64


def attach_parent(index: DataFrame) -> DataFrame:
    """Each page with its parent's id, null where the parent is not in the index."""
    parents = index.select(F.col("id").alias("parent_id"), F.lit(True).alias("_present"))
    joined = spread_join(index.select("pos", "id", "parent_id", "title"), parents, ["parent_id"])
    return joined.select("pos", "id", "title", F.when(F.col("_present"), F.col("parent_id")).alias("parent_id"))


def root_pages(index: DataFrame) -> DataFrame:
    """Pages without a parent, or whose parent is not in the index."""
    parents = index.select(F.col("id").alias("parent_id"))
    return spread_join(index.select("pos", "id", "parent_id", "title"), parents, ["parent_id"], "left_anti").select(
        "pos", "id", "title"
    )


def sibling_rank(index: DataFrame) -> DataFrame:
    """Position of each page among the children of its parent."""
    return ranked(index.select("pos", "id", "parent_id"), ["pos", "id"], "sibling_rank", ["parent_id"])


def child_pages(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Children of the given pages, in sibling order by ``pos``."""
    parents = ids.select(F.col("id").alias("parent_id")).distinct()
    children = index.where(F.col("parent_id").isNotNull()).select("parent_id", "pos", "id", "title")
    return spread_join(children, parents, ["parent_id"], "left_semi")


def build_forest(index: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """The index columns, ``root_id, depth, is_root, path, ids`` and one array per carried column, root first.

    ``path`` holds the listing positions from the root down; ordering by it is
    the preorder, with siblings in listing order.  Pages on or below a parent
    cycle reach no root and are left out (see :func:`cycle_pages`).  Every
    round doubles the reach of each pointer, so the frontier is empty after
    about log2(depth) rounds; a round that ends no chain proves that only
    cycles are left.

    Stored arrays end at BLOCK levels.  The arrays of deeper pages are put
    together where they are used, from the page's part below its anchor, the
    last page above it at a multiple of BLOCK, and the anchor's; a use that
    takes no array, such as :func:`cycle_pages`, reads none.
    """
    pages = store(dedupe_by_id(index), "forest-pages")
    carried = {"path": F.col("pos"), "ids": F.col("id"), **(carry or {})}
    own = pages.select("id", "parent_id", *(F.array(expr).alias(name) for name, expr in carried.items()))
    present = pages.select(F.col("id").alias("parent_id"), F.lit(True).alias("_present"))
    links = store(
        spread_join(own, present, ["parent_id"]).select(
            "id", F.when(F.col("_present"), F.col("parent_id")).alias("up"), *carried
        ),
        "forest-links",
    )
    longer = {name: F.concat(f"_{name}", name) for name in carried}
    finished, pending = _followed(links.where(F.col("up").isNull()), links.where(F.col("up").isNotNull()), longer, BLOCK.bit_length() - 1)
    level = (F.size("ids") - 1).alias("depth")
    parts = finished.select("id", F.lit(None).cast("string").alias("_anchor"), F.col("ids")[0].alias("root_id"), level, *carried)
    above = None
    if pending is not None:
        deep = _below_blocks(finished, pending)
        at = F.col("depth") % BLOCK  # levels below the anchor
        parts = parts.unionByName(deep.select(
            "id", F.element_at("ids", F.lit(BLOCK) - at).alias("_anchor"), "root_id", "depth",
            *(F.slice(name, F.lit(BLOCK + 1) - at, at).alias(name) for name in carried),
        ))
        roots = finished.where(F.size("ids") == 1).select("id", "up", *carried)
        above, _ = _followed(roots, deep.where(at == 0).select("id", "up", *carried), longer)

    forest = pages.join(parts, "id").select(
        *pages.columns, "root_id", "depth", (F.col("depth") == 0).alias("is_root"), *carried, *(["_anchor"] if pending is not None else [])
    )
    forest = store(forest, "forest")  # nearly every use of a forest reads it more than once
    if above is None:
        return forest
    anchors = above.select(F.col("id").alias("_anchor"), *(F.col(n).alias(f"_{n}") for n in carried))
    whole = {n: F.when(F.col("_anchor").isNull(), F.col(n)).otherwise(F.concat(f"_{n}", n)).alias(n) for n in carried}
    return spread_join(forest, anchors, ["_anchor"]).select(*(whole.get(c, F.col(c)) for c in forest.columns if c != "_anchor"))


def _followed(
    finished: DataFrame, pending: DataFrame, longer: dict[str, Column], rounds: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Follow the pointers ``up`` of ``pending``, doubling their reach by a join a round.

    Both have ``id, up`` and the columns of ``longer``, which are combined with
    those of the row above, named with a leading underscore.  Returns the rows
    that reach an end and, after ``rounds``, those that may still do so.
    """
    open_links = None
    while True:
        remaining = pending.count()
        if remaining in (0, open_links):
            return finished, None
        if rounds == 0:
            return finished, pending
        open_links, rounds = remaining, None if rounds is None else rounds - 1
        wanted = pending.select(F.col("up").alias("id")).distinct()
        above = finished.unionByName(pending).join(wanted, "id", "left_semi").select(
            F.col("id").alias("up"), F.col("up").alias("_up"), *(F.col(n).alias(f"_{n}") for n in longer)
        )
        moved = store(
            spread_join(pending, above, ["up"], "inner").select(
                "id", F.col("_up").alias("up"), *(combined.alias(n) for n, combined in longer.items())
            ),
            "forest-round",
        )
        finished = finished.unionByName(moved.where(F.col("up").isNull()))
        pending = moved.where(F.col("up").isNotNull())


def _below_blocks(finished: DataFrame, pending: DataFrame) -> DataFrame:
    """``pending`` with the ``depth`` and ``root_id`` of its pages that reach a root; only numbers and ids are followed."""
    ends = finished.select("id", "up", (F.size("ids") - 1).alias("depth"), F.col("ids")[0].alias("root_id"))
    links = pending.select("id", "up", F.size("ids").alias("depth"), F.lit(None).cast("string").alias("root_id"))
    further = {"depth": F.col("depth") + F.col("_depth"), "root_id": F.coalesce("root_id", "_root_id")}
    reached, _ = _followed(ends, links, further)
    # Pages above BLOCK levels are among the ends, too.
    return store(pending.join(reached.where(F.col("depth") >= BLOCK).select("id", "depth", "root_id"), "id"), "forest-deep")


def cycle_pages(index: DataFrame, forest: DataFrame) -> DataFrame:
    """Indexed pages that reach no root."""
    return dedupe_by_id(index).join(forest.select("id"), "id", "left_anti")


def find_subtree(forest: DataFrame, page_id: str) -> DataFrame:
    """A page and everything below it, with depth and path counted from that page."""
    level = F.array_position("ids", page_id).cast("int")
    return forest.where(F.array_contains("ids", page_id)).withColumns(
        {"depth": F.size("ids") - level, "path": F.slice("path", level, F.size("path"))}
    )


def flatten_preorder(forest: DataFrame, now: datetime | None = None) -> DataFrame:
    """The forest in depth-first order with ``ordinal`` counted from 1."""
    flat = ranked(forest, ["path"], "ordinal")
    if now is None:
        return flat
    return flat.withColumn("indexed_at", F.lit(now).cast("timestamp_ntz")).withColumn("page_number", F.lit(0))


def preorder(index: DataFrame) -> DataFrame:
    return flatten_preorder(build_forest(index))


def ancestors(index: DataFrame, forest: DataFrame, ids: DataFrame) -> DataFrame:
    """Ancestor ids of the given pages, topmost first.

    A chain that ends at a parent missing from the index counts as no chain at all.
    """
    orphan_roots = (
        dedupe_by_id(index).where(F.col("parent_id").isNotNull()).select(F.col("id").alias("root_id"))
        .join(forest.where("is_root").select("root_id"), "root_id", "left_semi")
        .withColumn("_orphan", F.lit(True))
    )
    wanted = forest.join(ids.select("id").distinct(), "id", "left_semi").select("id", "root_id", "ids")
    return spread_join(wanted, orphan_roots, ["root_id"]).select(
        "id",
        F.when(F.col("_orphan"), F.array().cast("array<string>"))
        .otherwise(F.slice("ids", F.lit(1), F.size("ids") - 1))
        .alias("ancestors"),
    )


def with_names(index: DataFrame) -> DataFrame:
    """A forest that also carries the folder name of every ancestor (``names``)."""
    return build_forest(index, {"names": F.concat(F.col("id"), F.lit("-"), slugify50(F.col("title")))})


def page_paths(named_forest: DataFrame, root: str) -> DataFrame:
    """Folder and file path of each page; a page lives in the folder of its parent."""
    folder = F.concat_ws("/", F.lit(root), F.slice("names", F.lit(1), F.size("names") - 1))
    return named_forest.select(
        "id",
        folder.alias("dir"),
        F.concat(folder, F.lit("/"), F.element_at("names", -1), F.lit(".html")).alias("path"),
    )


def page_html_path(index: DataFrame, ids: DataFrame, root: str) -> DataFrame:
    """Path of the given pages with unshortened names; see :func:`ancestors` for broken chains."""
    forest = build_forest(index, {"names": page_filename(F.col("id"), F.col("title"), "")})
    chains = ancestors(index, forest, ids)
    names = forest.select("id", "names")
    above = F.when(F.size("ancestors") == 0, F.array().cast("array<string>")).otherwise(
        F.slice("names", F.lit(1), F.size("names") - 1)
    )
    return chains.join(names, "id").select(
        "id",
        F.concat(F.concat_ws("/", F.lit(root), above, F.element_at("names", -1)), F.lit(".html")).alias("path"),
    )


def site_tree(files: DataFrame, collation: str = "UTF8_BINARY") -> DataFrame:
    """The folder tree of file paths as an ordered bullet list, one row per line.

    Folders come before files at every level, in code unit order; files are
    ordered by ``collation``.
    """
    def step(kind: int, folder: Column, file: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), folder.alias("folder"), F.collate(file, collation).alias("file"))

    def folder_step(name: Column) -> Column:
        return step(0, name, F.lit(""))

    exploded = files.select("path", F.split("path", "/").alias("parts"))
    file_name = F.element_at("parts", -1)
    file_lines = exploded.select(
        F.concat(
            F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), folder_step),
            F.array(step(1, F.lit(""), file_name)),
        ).alias("key"),
        F.col("path").alias("tie"),
        F.concat(
            F.repeat(F.lit("  "), F.size("parts") - 1), F.lit("- ["), file_name, F.lit("]("), F.col("path"), F.lit(")")
        ).alias("line"),
    )
    folders = (
        exploded.where(F.size("parts") > 1)
        .select(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("folder"))
        .distinct()
        .select(F.transform(F.sequence(F.lit(1), F.size("folder")), lambda n: F.slice("folder", F.lit(1), n)).alias("above"))
        .select(F.explode("above").alias("folder"))
        .distinct()
    )
    folder_lines = folders.select(
        F.transform("folder", folder_step).alias("key"),
        F.lit("").alias("tie"),
        F.concat(
            F.repeat(F.lit("  "), F.size("folder") - 1), F.lit("- **"), F.element_at("folder", -1), F.lit("/**")
        ).alias("line"),
    )
    return ranked(folder_lines.unionByName(file_lines), ["key", "tie"], "ordinal").select("ordinal", "line")


def sorted_site_tree(files: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """The site tree below its heading, files in dictionary order: ordinal 0 is the heading line."""
    heading = files.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("ordinal"), F.lit(R.SITE_TREE_HEADING).alias("line")
    )
    return heading.unionByName(site_tree(files, collation))


def nested_tree(forest: DataFrame) -> DataFrame:
    """The nested tree document, one block of text per page, in document order.

    Blocks joined by newlines in ``ordinal`` order form the whole YAML file;
    nesting is indentation only, so no tree has to be gathered anywhere.
    """
    parents = (
        forest.where("depth > 0").select(F.element_at("ids", -2).alias("id")).distinct().withColumn("_inner", F.lit(True))
    )
    indent = F.repeat(F.lit("    "), F.col("depth"))
    quoted = lambda c: F.concat(F.lit('"'), yaml_quote(F.replace(c, F.lit("\\"), F.lit("\\\\"))), F.lit('"'))
    block = F.concat_ws(
        "\n",
        F.concat(indent, F.lit("- id: "), quoted(F.col("id"))),
        F.concat(indent, F.lit("  title: "), quoted(F.col("title"))),
        F.concat(indent, F.when(F.col("_inner"), "  children:").otherwise("  children: []")),
    )
    return flatten_preorder(forest.select("id", "title", "depth", "path", "root_id").join(parents, "id", "left")).select(
        "ordinal", "root_id", "id", block.alias("block")
    )
