"""The whole job: listing to index, index to queue, queue to bodies, bodies to Markdown."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index_ops as ix
from .operators import refs, tree
from .plans.storage import store, tables_dropped
from .schemas import META_COLUMNS
from .sources import changes, readers, sinks


@dataclass(frozen=True)
class SyncOptions:
    """``mode`` is full or incremental (see :func:`update_index`).

    ``page_id`` narrows the run to one page and, with ``subtree``, all below it.
    """

    space: str
    landing: str
    tables: str
    now: datetime
    root: str = "out"
    mode: str = "full"
    page_id: str | None = None
    subtree: bool = True
    force: bool = False
    limit: int | None = None
    page_size: int = 100
    markdown: refs.MarkdownOptions = field(default_factory=refs.MarkdownOptions)


# The tables of a job; all share one count of runs.  Those of changes hold the pages a run touches, images the ones it found,
# the others a whole state per run.
CHANGES = ("html", "markdown", "references")
STATES = ("page_index", "page_tree", "queue", "site_tree")
TABLES = (*STATES, *CHANGES, "images")


def next_run(spark: SparkSession, o: SyncOptions) -> int:
    return 1 + max(sinks.latest_run(spark, f"{o.tables}/{table}", o.space) or 0 for table in TABLES)


def _chosen(forest: DataFrame, o: SyncOptions) -> DataFrame:
    """The part of the forest a run is about."""
    if o.page_id is None:
        return forest
    chosen = tree.find_subtree(forest, o.page_id) if o.subtree else forest.where(F.col("id") == o.page_id)
    if chosen.isEmpty():
        raise ValueError(f"page {o.page_id} is not in the tree")
    return chosen


def first_index(listing: DataFrame, now: datetime) -> DataFrame:
    """Index rows of a first listing: nothing has been fetched yet."""
    return ix.dedupe_by_id(
        listing.select(
            *META_COLUMNS,
            F.lit(now).cast("timestamp_ntz").alias("indexed_at"),
            F.col("api_page_number").alias("page_number"),
            F.lit(None).cast("int").alias("downloaded_version"),
            F.lit(None).cast("timestamp_ntz").alias("downloaded_at"),
        )
    )


def update_index(listing: DataFrame, index: DataFrame, now: datetime, mode: str = "full") -> DataFrame:
    """The index after a listing, or the old index when nothing changed.

    A full update removes pages the listing lacks.  An incremental one looks
    only at pages modified since the day of the oldest index row and removes none.
    """
    current = ix.dedupe_by_id(ix.page_metadata(listing))
    if mode == "incremental":
        since = index.select(F.min("indexed_at")).scalar()
        current = ix.upsert_modified(index, ix.modified_since(current, since))
    differing = ix.diff_snapshots(current, index, mode).where(F.col("change") != "unchanged")
    return index if differing.isEmpty() else ix.rebuild_index(current, index, now)


def sync_corpus(
    spark: SparkSession, options: SyncOptions, users: DataFrame, attachments: DataFrame | None = None
) -> DataFrame:
    """Bring the state tables up to date and return this run's Markdown.

    Writes the tables page_tree, queue, html, markdown, references, images
    (when there are ``attachments``) and site_tree, and last page_index: a page
    counts as downloaded only after its body and Markdown are stored.  Besides
    the fetched pages those are converted again that a change may touch (see
    :func:`refs.concerned_pages`), so that the Markdown table is always what a
    conversion of all stored bodies would give.  Intermediate tables are
    deleted at the end.
    """
    with tables_dropped(spark):
        return _sync(spark, options, users, attachments)


def _sync(spark: SparkSession, o: SyncOptions, users: DataFrame, attachments: DataFrame | None) -> DataFrame:
    index_table = f"{o.tables}/page_index"
    run_id = next_run(spark, o)
    root = f"{o.root}/{o.space}"

    def write(df: DataFrame, table: str) -> DataFrame:
        sinks.write_run(df, f"{o.tables}/{table}", o.space, run_id, o.now)
        return sinks.read_latest(spark, f"{o.tables}/{table}", o.space)

    ends = store(readers.listing_ends(readers.read_envelopes(spark, o.landing, with_body=False)), "listing-ends")
    listing = store(readers.scan_page_metadata(spark, o.landing, ends).where(F.col("space") == o.space), "listing")
    previous = sinks.read_latest(spark, index_table, o.space)
    index = store(
        first_index(listing, o.now) if previous is None else update_index(listing, previous, o.now, o.mode), "index"
    )

    forest = tree.with_names(index)
    paths = tree.page_paths(forest, root)
    sinks.write_tree(forest, f"{o.tables}/page_tree", o.space, run_id, o.now)
    chosen = _chosen(forest, o)

    ordered = tree.flatten_preorder(chosen.drop("pos")).withColumnRenamed("ordinal", "pos").select(*META_COLUMNS)
    queue = ix.queue_status(ordered, index, o.force)
    queue = write(ix.limit_pages(queue, o.limit) if o.limit else queue, "queue")
    plan = ix.download_plan(queue, paths, index, root, o.force)
    wanted = store(plan.where(F.col("action") != "skip").select("id"), "wanted")

    listed = readers.scan_page_envelopes(spark, o.landing, ends).where(F.col("space") == o.space)
    bodies = ix.dedupe_by_id(listed.join(wanted, "id", "left_semi").select("pos", "id", F.col("body").alias("html")))
    kept = changes.read_current(spark, f"{o.tables}/references", o.space)
    kept = None if kept is None else store(kept.select("id", "kind", "key"), "kept-references")
    gone = None if previous is None else store(previous.select("id").join(index.select("id"), "id", "left_anti"), "gone")
    changes.write_changes(sinks.html_files(bodies, paths), f"{o.tables}/html", o.space, run_id, o.now, gone)
    html = sinks.read_latest(spark, f"{o.tables}/html", o.space)
    fetched = html.select("id", "html").join(index.select("id", "title", "version"), "id")

    ids = html.select("id")
    if kept is not None and previous is not None:
        ids = ids.unionByName(refs.concerned_pages(kept, previous, index, ids, o.markdown)).distinct()
    markdown = _converted(spark, o, run_id, store(ids.join(index.select("id"), "id", "left_semi"), "to-convert"), index, users, gone)
    if attachments is not None:
        resolved = refs.resolve_attachments(store(refs.image_manifest(markdown), "manifest"), attachments)
        write(sinks.image_files(resolved, paths), "images")
    done = store(ix.merge_download_state(index, fetched.select("id", "version"), o.now), "done")
    stored = done.where(F.col("downloaded_at").isNotNull()).select("id")
    files = paths.join(stored, "id", "left_semi").select(
        F.regexp_replace(F.substring("path", len(root) + 2, 1 << 30), r"\.html$", ".md").alias("path")
    )
    write(tree.sorted_site_tree(files), "site_tree")
    sinks.write_index(done, index_table, o.space, run_id, o.now, o.page_size)
    return markdown


def stored_bodies(spark: SparkSession, options: SyncOptions, index: DataFrame) -> refs.Bodies:
    """The lookup of stored bodies by id; the bodies of other pages are not moved."""

    def bodies(ids: DataFrame) -> DataFrame:
        rows = changes.read_current(spark, f"{options.tables}/html", options.space, only=ids)
        if rows is None:
            return spark.createDataFrame([], "id string, title string, html string")
        return rows.select("id", "html").join(index.select("id", "title"), "id").select("id", "title", "html")

    return bodies


def _converted(
    spark: SparkSession, o: SyncOptions, run_id: int, ids: DataFrame, index: DataFrame, users: DataFrame, gone: DataFrame | None = None
) -> DataFrame:
    """Convert the stored bodies of ``ids`` as run ``run_id`` of the tables references and markdown, which removes the pages in ``gone``."""
    bodies = stored_bodies(spark, o, index)
    pages = store(bodies(ids), "pages")
    found = store(refs.page_refs(pages, o.markdown), "refs")
    changes.write_changes(refs.kept_references(pages, found), f"{o.tables}/references", o.space, run_id, o.now, gone)
    markdown = refs.pages_to_markdown(pages, index, users, o.markdown, bodies=bodies, found=found)
    changes.write_changes(markdown, f"{o.tables}/markdown", o.space, run_id, o.now, gone)
    return sinks.read_latest(spark, f"{o.tables}/markdown", o.space)


def current_table(spark: SparkSession, options: SyncOptions, table: str) -> DataFrame | None:
    """The html or markdown table as it stands: the newest row of each page that the index still has."""
    rows = changes.read_current(spark, f"{options.tables}/{table}", options.space)
    index = sinks.read_latest(spark, f"{options.tables}/page_index", options.space)
    return rows if rows is None or index is None else rows.join(index.select("id"), "id", "left_semi")


def maintain(spark: SparkSession, options: SyncOptions, keep: int = 2) -> dict[str, int]:
    """Merge the runs of the tables of changes that are due and delete what is no longer needed.

    ``keep`` is the number of manifests, or of whole states, that stay for
    readers.  What the tables hold does not change.  Returns the number of
    segments by table.
    """
    counts = {}
    for name in CHANGES:
        table = f"{options.tables}/{name}"
        snapshot = changes.compact(spark, table, options.space)
        changes.retire(spark, table, options.space, keep)
        counts[name] = 0 if snapshot is None else len(snapshot.segments)
    for name in STATES:
        sinks.retire_runs(spark, f"{options.tables}/{name}", options.space, keep)
    return counts


def transform_stored(spark: SparkSession, options: SyncOptions, users: DataFrame) -> DataFrame:
    """Convert stored bodies that have no Markdown, or an older one, or include a page of a newer body; with ``force`` all of them.

    ``page_id``, ``subtree`` and ``limit`` narrow the run, the limit in listing
    order over what is left to do, so limited runs go on where the last one
    ended.  Returns the Markdown written.
    """
    with tables_dropped(spark):
        return _transform(spark, options, users)


def _transform(spark: SparkSession, o: SyncOptions, users: DataFrame) -> DataFrame:
    index = sinks.read_latest(spark, f"{o.tables}/page_index", o.space)
    html = current_table(spark, o, "html")
    if index is None or html is None:
        raise ValueError(f"nothing is stored for space {o.space}")
    pending = html.select("id", "run")
    done = current_table(spark, o, "markdown")
    if done is not None and not o.force:
        made = done.select("id", F.col("run").alias("_made"))
        kept = changes.read_current(spark, f"{o.tables}/references", o.space)
        older = pending.join(made, "id", "left").where(F.col("_made").isNull() | (F.col("_made") < F.col("run"))).select("id")
        if kept is not None:
            older = older.unionByName(_older_than_included(kept, index, pending, made))
        pending = older.distinct()
    if o.page_id is not None:
        pending = pending.join(_chosen(tree.build_forest(index), o).select("id"), "id", "left_semi")
    listed = pending.join(index.select("id", "pos", "title"), "id").select("id", "pos", "title")
    wanted = store(ix.limit_pages(listed, o.limit) if o.limit else listed, "pending")
    return _converted(spark, o, next_run(spark, o), wanted.select("id"), index, users)


def _older_than_included(kept: DataFrame, index: DataFrame, html: DataFrame, made: DataFrame) -> DataFrame:
    """Ids of the pages whose Markdown is older than the body of a page they include."""
    titled = kept.where(F.col("kind") == "include").select("id", F.col("key").alias("title"))
    bodies = html.select(F.col("id").alias("target_id"), F.col("run").alias("_body"))
    dated = refs.page_by_title(index, titled).join(bodies, "target_id").join(made, "id")
    return dated.where(F.col("_made") < F.col("_body")).select("id").distinct()


def migrate_sidecars(spark: SparkSession, options: SyncOptions, root: str) -> DataFrame:
    """Take the download state from the sidecar files below ``root`` into a new run of the index.

    Returns the sidecars of pages that the index does not have.
    """
    o, table = options, f"{options.tables}/page_index"
    index = sinks.read_latest(spark, table, o.space)
    if index is None:
        raise ValueError(f"no index is stored for space {o.space}")
    merged, skipped = ix.merge_sidecars(index, store(readers.scan_meta_sidecars(spark, root), "sidecars"))
    sinks.write_index(merged, table, o.space, next_run(spark, o), o.now, o.page_size)
    return skipped
