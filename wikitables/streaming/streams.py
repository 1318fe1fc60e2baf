"""Incremental jobs: ingest, index upsert and conversion of landed listings.

Each stream reads the landing folder once per file, with the checkpoint taking
the place of a resume offset, and ends when nothing is left (``availableNow``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.refs import MarkdownOptions, including_pages, kept_references, page_refs, pages_to_markdown
from ..plans.storage import store, tables_dropped
from ..schemas import ENVELOPE, ENVELOPE_WITHOUT_BODY, INDEX_COLUMNS, META_COLUMNS, PAGE_INDEX
from ..sources.buckets import BUCKETS, read_manifest, read_state, touched_buckets, write_state
from ..sources.readers import envelope_cutoff, flatten_page, listing_ends, read_envelopes


def _pages(spark: SparkSession, landing: str, space: str, files_per_batch: int | None, with_body: bool = False) -> DataFrame:
    """The landed pages of a space, up to the end of its listing as landed when the stream starts."""
    reader = spark.readStream.schema(ENVELOPE if with_body else ENVELOPE_WITHOUT_BODY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ends = store(listing_ends(read_envelopes(spark, landing, with_body=False)), "listing-ends")
    landed = reader.json(landing).where(F.col("space") == space)
    return flatten_page(envelope_cutoff(landed, ends), with_body)


def stream_index_ingest(
    spark: SparkSession, landing: str, checkpoint: str, table: str, space: str, now: datetime, files_per_batch: int | None = None
) -> StreamingQuery:
    """Append the index rows of every landed listing of a space exactly once."""
    rows = _pages(spark, landing, space, files_per_batch).select(
        *META_COLUMNS,
        F.lit(now).cast("timestamp_ntz").alias("indexed_at"),
        F.col("api_page_number").alias("page_number"),
        F.lit(None).cast("int").alias("downloaded_version"),
        F.lit(None).cast("timestamp_ntz").alias("downloaded_at"),
    )
    return (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table)
        .outputMode("append").trigger(availableNow=True).start()
    )


def newest_by_id(pages: DataFrame) -> DataFrame:
    """One row per id: the highest version, then the latest modification, then the last position."""
    rest = [c for c in pages.columns if c != "id"]
    age = F.struct(F.coalesce("version", F.lit(0)).alias("version"), "modified_at", "pos")
    return pages.groupBy("id").agg(F.max_by(F.struct(*rest), age).alias("_newest")).select(
        *("id" if c == "id" else F.col(f"_newest.{c}").alias(c) for c in pages.columns)
    )


def merge_pages(index: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """The index rows after listed pages, one per id, were merged in.

    Of a page's stored row and its listed one the newer by version, date of
    modification and position gives the metadata, so the rows do not depend on
    the order in which listings land.  A row of a new version is stamped with
    ``now`` and keeps the download state, so that it is queued as updated.
    """
    i, p = index.alias("i"), pages.alias("p")
    age = lambda side: F.struct(F.coalesce(f"{side}.version", F.lit(0)).alias("version"), f"{side}.modified_at", f"{side}.pos")
    stored, listed = F.col("i.id").isNotNull(), F.col("p.id").isNotNull()
    newer = listed & (~stored | (age("p") > age("i")))
    same_version = F.col("i.version").eqNullSafe(F.col("p.version"))
    columns = {c: F.when(newer, F.col(f"p.{c}")).otherwise(F.col(f"i.{c}")) for c in META_COLUMNS}
    columns["indexed_at"] = F.when(newer & ~(stored & same_version), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("i.indexed_at"))
    columns["page_number"] = F.coalesce("i.page_number", F.lit(0))
    return i.join(p, F.col("i.id") == F.col("p.id"), "full_outer").select(
        *(columns.get(c, F.col(f"i.{c}")).alias(c) for c in INDEX_COLUMNS)
    )


def upsert_batch(batch: DataFrame, batch_id: int, table: str, space: str, now: datetime, buckets: int = BUCKETS) -> None:
    """Merge one batch of listed pages into the index as run ``batch_id + 1``, which rewrites the buckets of these pages.

    A batch that was already merged is skipped, so repeating it is harmless.
    """
    spark = batch.sparkSession
    before = read_manifest(spark, table, space)
    if before is not None and before.run > batch_id:
        return
    with tables_dropped(spark):
        pages = store(newest_by_id(batch.select(*META_COLUMNS)), "batch")
        touched = touched_buckets(pages, before.buckets if before else buckets)
        index = read_state(spark, table, space, PAGE_INDEX, before, touched) if before else spark.createDataFrame([], PAGE_INDEX)
        write_state(merge_pages(index, pages, now), table, space, batch_id + 1, touched, before, buckets)


def read_upserted(spark: SparkSession, table: str, space: str) -> DataFrame:
    """The index that :func:`stream_index_upsert` keeps, as of its newest run."""
    return read_state(spark, table, space, PAGE_INDEX)


def stream_index_upsert(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    table: str,
    space: str,
    now: datetime,
    files_per_batch: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the index current: every batch of changed pages becomes a new run of the table, see :mod:`wikitables.sources.buckets`."""
    return (
        _pages(spark, landing, space, files_per_batch)
        .writeStream.foreachBatch(lambda batch, batch_id: upsert_batch(batch, batch_id, table, space, now, buckets))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _earlier(spark: SparkSession, table: str, batch_id: int, schema: str) -> DataFrame:
    """What the batches before ``batch_id`` have written."""
    try:
        return spark.read.parquet(table).where(F.col("batch") < batch_id)
    except AnalysisException:  # no batch has been written yet
        return spark.createDataFrame([], f"{schema}, batch int")


_BODY = "id string, title string, html string, version int, modified_at timestamp_ntz, pos bigint"


def transform_batch(
    batch: DataFrame, batch_id: int, table: str, index: DataFrame, users: DataFrame, options: MarkdownOptions, force: bool = False
) -> None:
    """Convert the pages of one batch that are new or newer than before, and the pages that include one of them.

    The bodies that have landed and the references found in them are kept
    beside the table, so that a page may include any page landed so far; only
    the bodies that a batch needs are read.  ``force`` converts pages of an
    unchanged version, too.
    """
    spark = batch.sparkSession
    with tables_dropped(spark):
        listed = newest_by_id(store(batch.select("id", "title", F.col("body").alias("html"), "version", "modified_at", "pos"), "batch"))
        age = F.struct(F.coalesce("version", F.lit(0)).alias("version"), "modified_at", "pos")
        earlier = _earlier(spark, f"{table}-bodies", batch_id, _BODY)
        newest = store(earlier.groupBy("id").agg(F.max_by("batch", F.struct(age, "batch")).alias("batch"), F.max(age).alias("_age")), "known-bodies")
        known = newest.select("id", F.col("_age.version").alias("_version"), "_age")
        joined = listed.join(known, "id", "left")
        fresh = F.col("_age").isNull() | (F.coalesce("version", F.lit(0)) > F.col("_version"))
        chosen = joined.where(fresh | ((age >= F.col("_age")) & F.lit(force))).drop("_age", "_version")
        chosen.write.mode("overwrite").parquet(f"{table}-bodies/batch={batch_id}")
        arrived = spark.read.schema(chosen.schema).parquet(f"{table}-bodies/batch={batch_id}")

        def bodies(ids: DataFrame) -> DataFrame:
            """The newest body of each of ``ids`` that has landed."""
            here = arrived.join(ids, "id", "left_semi").select("id", "title", "html")
            wanted = newest.join(ids, "id", "left_semi").join(arrived.select("id"), "id", "left_anti").select("id", "batch")
            return here.unionByName(earlier.join(store(wanted, "wanted-bodies"), ["id", "batch"], "left_semi").select("id", "title", "html"))

        found = _earlier(spark, f"{table}-references", batch_id, "id string, kind string, key string")
        current = found.join(found.groupBy("id").agg(F.max("batch").alias("batch")), ["id", "batch"], "left_semi")
        ids = arrived.select("id")
        again = including_pages(current, index, ids)
        pages = store(bodies(store(ids.unionByName(again).distinct(), "to-convert")), "pages")
        referred = store(page_refs(pages, options), "refs")
        kept_references(pages, referred).write.mode("overwrite").parquet(f"{table}-references/batch={batch_id}")
        markdown = pages_to_markdown(pages, index, users, options, bodies=bodies, found=referred)
        markdown.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def read_transformed(spark: SparkSession, table: str) -> DataFrame:
    """The Markdown of each page from its newest batch."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["id", "batch"], "left_semi")


def stream_transform(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    table: str,
    space: str,
    index: DataFrame,
    users: DataFrame,
    options: MarkdownOptions = MarkdownOptions(),
    files_per_batch: int | None = None,
    force: bool = False,
) -> StreamingQuery:
    """Convert landed pages of a space to Markdown; without ``force`` a page is converted again when a newer version lands, or one of a page it includes."""
    pages = _pages(spark, landing, space, files_per_batch, with_body=True)
    return (
        pages.writeStream.foreachBatch(
            lambda batch, batch_id: transform_batch(batch, batch_id, table, index, users, options, force)
        )
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
