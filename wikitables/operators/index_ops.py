"""Operators over the page index: filters, snapshot diff, rebuild, queue and download state.

Every page table is keyed by ``id``; ``pos`` carries the listing order.  Joins
here are between sides that are unique by ``id`` (see :func:`dedupe_by_id`), so
no key can be hot.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_status
from ..plans.ranking import ranked
from ..plans.skew import spread_join
from ..schemas import INDEX_COLUMNS, META_COLUMNS


def given(col: Column) -> Column:
    """Null for the values that count as missing: null, 0 and the empty string."""
    return F.nullif(col, F.lit(0))


def page_metadata(pages: DataFrame) -> DataFrame:
    return pages.select(*META_COLUMNS)


def limit_pages(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first ``n`` rows in listing order: each task sends on at most ``n``."""
    return df.orderBy(order).limit(n)


def pages_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids the table does not hold."""
    return ids.select("id").distinct().join(df, "id", "left_anti")


def page_bodies(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Bodies of the requested pages; a missing body is the empty string."""
    return pages_by_id(pages, ids).withColumn("body", F.coalesce("body", F.lit("")))


def modified_since(df: DataFrame, since: Column) -> DataFrame:
    """Pages modified on or after the day of ``since``."""
    return df.where(F.col("modified_at") >= F.date_trunc("day", since))


def search_results(df: DataFrame, since: Column) -> DataFrame:
    """Metadata of the pages modified since a day, latest first."""
    return order_modified_desc(modified_since(page_metadata(df), since))


def order_modified_desc(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("modified_at").desc(), F.col("id"))


def point_lookup(index: DataFrame, page_id: str) -> DataFrame:
    """The first index row of a page."""
    return index.where(F.col("id") == page_id).orderBy("pos").limit(1)


def dedupe_by_id(df: DataFrame) -> DataFrame:
    """One row per id: the last value wins and keeps the first position."""
    rest = [c for c in df.columns if c not in ("id", "pos")]
    return (
        df.groupBy("id")
        .agg(F.max_by(F.struct(*rest), "pos").alias("_last"), F.min("pos").alias("pos"))
        .select("pos", "id", *(F.col(f"_last.{c}").alias(c) for c in rest))
        .select(*df.columns)
    )


def diff_snapshots(current: DataFrame, index: DataFrame, mode: str = "full") -> DataFrame:
    """Classify every page as new, updated, deleted or unchanged.

    ``mode="incremental"`` knows only the modified pages and so never reports deletions.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode}")
    c, i = current.alias("c"), index.alias("i")
    both = c.join(i, F.col("c.id") == F.col("i.id"), "full_outer" if mode == "full" else "left")
    newer = given(F.col("c.version")) > given(F.col("i.version"))
    return both.select(
        F.coalesce("c.id", "i.id").alias("id"),
        F.coalesce("c.title", "i.title").alias("title"),
        F.col("i.version").alias("old_version"),
        F.col("c.version").alias("new_version"),
        F.when(F.col("i.id").isNull(), "new")
        .when(F.col("c.id").isNull(), "deleted")
        .when(newer, "updated")
        .otherwise("unchanged")
        .alias("change"),
    )


def update_summary(diff: DataFrame) -> DataFrame:
    change = F.col("change")
    return diff.agg(
        F.count_if(change == "new").alias("new_pages"),
        F.count_if(change == "updated").alias("updated_pages"),
        F.count_if(change == "deleted").alias("deleted_pages"),
        F.count_if(change != "deleted").alias("index_size"),
    )


def added_pages(current: DataFrame, index: DataFrame) -> DataFrame:
    return current.join(index, "id", "left_anti")


def deleted_pages(current: DataFrame, index: DataFrame) -> DataFrame:
    return index.join(current, "id", "left_anti")


def upsert_modified(index: DataFrame, modified: DataFrame) -> DataFrame:
    """Index metadata overlaid by the modified pages: whole rows, nulls included.

    Known pages keep their position, unknown ones follow after the last.
    """
    last = index.select(F.coalesce(F.max("pos"), F.lit(-1)).alias("last")).scalar()
    i, m = index.alias("i"), modified.alias("m")
    overlaid = F.col("m.id").isNotNull()
    value_columns = [c for c in META_COLUMNS if c not in ("pos", "id")]
    return i.join(m, F.col("i.id") == F.col("m.id"), "full_outer").select(
        F.coalesce(F.col("i.pos"), last + 1 + F.col("m.pos")).alias("pos"),
        F.coalesce("i.id", "m.id").alias("id"),
        *(F.when(overlaid, F.col(f"m.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in value_columns),
    )


def union_upsert(*versions: DataFrame) -> DataFrame:
    """Metadata of several snapshots in rising priority: the last snapshot that has a page wins."""
    tagged = [page_metadata(v).withColumn("_source", F.lit(n)) for n, v in enumerate(versions)]
    everything = tagged[0]
    for part in tagged[1:]:
        everything = everything.unionByName(part)
    rest = [c for c in META_COLUMNS if c not in ("id", "pos")]
    priority = F.struct("_source", "pos")
    return (
        everything.groupBy("id")
        .agg(F.max_by(F.struct(*rest), priority).alias("_last"), F.min_by("pos", priority).alias("pos"))
        .select("pos", "id", *(F.col(f"_last.{c}").alias(c) for c in rest))
    )


def rebuild_index(
    current: DataFrame, index: DataFrame, now: datetime, carry_download_state: bool = True
) -> DataFrame:
    """The index after an update: known rows of the same version stay, all others are written afresh.

    A row counts as the same version too when either version is missing.  With
    ``carry_download_state`` a refreshed row remembers which version was last
    fetched, so that it is queued as updated instead of new.
    """
    c, i = current.alias("c"), index.alias("i")
    known = F.col("i.id").isNotNull()
    old, new = given(F.col("i.version")), given(F.col("c.version"))
    keep = known & (old.isNull() | new.isNull() | (old == new))
    stamp = F.lit(now).cast("timestamp_ntz")

    def fresh(column: str) -> Column:
        if column in META_COLUMNS:
            return F.col(f"c.{column}")
        if column == "indexed_at":
            return stamp
        if column == "page_number":
            return F.coalesce(F.col("i.page_number"), F.lit(0))
        return F.col(f"i.{column}") if carry_download_state else F.lit(None)

    return c.join(i, F.col("c.id") == F.col("i.id"), "left").select(
        *(
            F.col("c.pos").alias("pos") if column == "pos"
            else F.when(keep, F.col(f"i.{column}")).otherwise(fresh(column)).alias(column)
            for column in INDEX_COLUMNS
        )
    )


def oldest_indexed(index: DataFrame) -> DataFrame:
    return index.agg(F.min("indexed_at").alias("oldest_indexed"))


def page_statuses(tree: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Tree pages with ``status`` new, updated or skip, from what the index says was fetched."""
    if force:
        return tree.withColumn("status", F.lit("new"))
    stored = index.select(
        "id",
        given(F.col("downloaded_version")).alias("_fetched"),
        page_status(
            F.col("version"), F.col("downloaded_version"), F.col("downloaded_at"), F.col("modified_at")
        )["needs_download"].alias("_stale"),
    )
    return (
        tree.join(stored, "id", "left")
        .withColumn(
            "status",
            F.when(F.col("_fetched").isNull(), "new").when(F.col("_stale"), "updated").otherwise("skip"),
        )
        .drop("_fetched", "_stale")
    )


def queue_status(tree: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """The pages to fetch, with the reason."""
    return page_statuses(tree, index, force).where(F.col("status") != "skip").withColumnRenamed("status", "queue_reason")


def queue_stats(statuses: DataFrame, limit: int | None = None) -> DataFrame:
    status = F.col("status")
    queued = F.count_if(status != "skip")
    return statuses.agg(
        F.count_if(status == "new").alias("new_pages"),
        F.count_if(status == "updated").alias("updated_pages"),
        F.count_if(status == "skip").alias("skipped_pages"),
        (F.least(queued, F.lit(limit)) if limit else queued).cast("bigint").alias("queued_pages"),
        F.count(F.lit(1)).alias("tree_pages"),
    )


def batch_number(df: DataFrame, size: int, order: str = "pos") -> DataFrame:
    """Number consecutive batches of ``size`` rows in listing order."""
    return (
        ranked(df, [order], "_rank")
        .withColumn("batch_no", F.expr(f"(_rank - 1) div {int(size)} + 1").cast("bigint"))
        .drop("_rank")
    )


def download_plan(
    queue: DataFrame, paths: DataFrame, index: DataFrame, root: str, force: bool = False
) -> DataFrame:
    """What to do with every queued page: skip, update or new, and in which folder its body goes."""
    stored = index.select("id", "downloaded_version", "downloaded_at")
    wanted = F.coalesce(F.col("version"), F.lit(0))
    fetched = F.col("downloaded_version").isNotNull() & F.col("downloaded_at").isNotNull()
    action = F.when(fetched & F.lit(not force) & (wanted == F.col("downloaded_version")), "skip").when(
        fetched, "update"
    ).otherwise("new")
    return (
        queue.drop("downloaded_version", "downloaded_at")
        .join(paths.select("id", "dir"), "id", "left")
        .join(stored, "id", "left")
        .select(
            "pos",
            "id",
            F.coalesce("dir", F.lit(root)).alias("dir"),
            action.alias("action"),
            F.col("downloaded_version").alias("old_version"),
            wanted.alias("new_version"),
        )
    )


def batch_stats(plan: DataFrame, size: int) -> DataFrame:
    return (
        batch_number(plan, size)
        .groupBy("batch_no")
        .agg(
            F.count_if(F.col("action") != "skip").alias("downloaded"),
            F.count_if(F.col("action") == "skip").alias("skipped"),
        )
    )


def merge_download_state(index: DataFrame, fetched: DataFrame, now: datetime) -> DataFrame:
    """Record the fetched versions; ids the index does not know change nothing."""
    latest = fetched.groupBy("id").agg(F.coalesce(F.max("version"), F.lit(0)).alias("_version"))
    hit = F.col("_version").isNotNull()
    return (
        index.join(latest, "id", "left")
        .withColumn("downloaded_version", F.when(hit, F.col("_version")).otherwise(F.col("downloaded_version")))
        .withColumn(
            "downloaded_at", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("downloaded_at"))
        )
        .drop("_version")
        .select(*index.columns)
    )


def merge_sidecars(index: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take download states from sidecar rows ``(path, page_id, version, downloaded_at)``.

    Returns the new index and the sidecars that belong to no indexed page.  Of
    several sidecars of one page the last by path counts.
    """
    last = sidecars.groupBy(F.col("page_id").alias("id")).agg(
        F.max_by(F.struct("version", "downloaded_at"), "path").alias("_meta")
    )
    hit = F.col("_meta").isNotNull()
    merged = (
        index.join(last, "id", "left")
        .withColumn("downloaded_version", F.when(hit, F.col("_meta.version")).otherwise(F.col("downloaded_version")))
        .withColumn("downloaded_at", F.when(hit, F.col("_meta.downloaded_at")).otherwise(F.col("downloaded_at")))
        .drop("_meta")
        .select(*index.columns)
    )
    known = index.select(F.col("id").alias("page_id"))
    return merged, spread_join(sidecars, known, ["page_id"], "left_anti")


def sidecar_stats(index: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars of indexed pages and all others, counted per page before the join."""
    known = index.select(F.col("id").alias("page_id"), F.lit(True).alias("_known"))
    counted = sidecars.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).join(known, "page_id", "left")

    def total(rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, F.col("_n"))), F.lit(0))

    return counted.agg(
        total(F.col("_known").isNotNull()).alias("migrated"), total(F.col("_known").isNull()).alias("skipped")
    )


def pending_transforms(html: DataFrame, markdown: DataFrame) -> DataFrame:
    """HTML files ``(path)`` without a Markdown file of the same folder and base name."""
    def base(df: DataFrame, ext: str) -> DataFrame:
        return df.withColumn("_base", F.expr(f"left(path, length(path) - {len(ext)})"))

    return base(html, ".html").join(base(markdown, ".md").select("_base"), "_base", "left_anti").drop("_base")


def files_to_process(html: DataFrame, markdown: DataFrame, n: int | None = None, force: bool = False) -> DataFrame:
    """Files to convert: the limit counts files in path order, then finished ones drop out."""
    chosen = limit_pages(html, n, "path") if n else html
    return chosen if force else pending_transforms(chosen, markdown)
