"""Readers: listing envelopes, users, attachments, page trees and sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_id
from ..schemas import ENVELOPE, ENVELOPE_WITHOUT_BODY, SIDECAR, USER
from .files import json_text, list_files, read_files


def read_envelopes(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """Listing responses, one JSON document per line; without bodies these are not parsed at all."""
    return spark.read.schema(ENVELOPE if with_body else ENVELOPE_WITHOUT_BODY).json(path)


def listing_ends(envelopes: DataFrame) -> DataFrame:
    """Per space the start of the response that ends its listing, the first that is short or names no next page."""
    terminal = (F.size("results") < F.col("limit")) | F.col("_links.next").isNull()
    return envelopes.groupBy("space").agg(F.min(F.when(terminal, F.col("start"))).alias("_end"))


def envelope_cutoff(envelopes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Drop the responses after the one that ends a listing.

    ``ends`` are its :func:`listing_ends`; pass them to read the responses only once.
    They are one row per space and go to the responses, which stay where they
    are: a join by space would bring all responses of a space to one task.
    """
    return (
        envelopes.join(F.broadcast(listing_ends(envelopes) if ends is None else ends), "space", "left")
        .where(F.col("_end").isNull() | (F.col("start") <= F.col("_end")))
        .drop("_end")
    )


def _text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def timestamp(value: Column) -> Column:
    """ISO-8601 text as a UTC timestamp without zone, whatever the session's time zone: its distance from the epoch."""
    seconds = (F.unix_micros(F.to_timestamp(value)).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def flatten_page(envelopes: DataFrame, with_body: bool = True) -> DataFrame:
    """One row per listed page.

    The parent is the last ancestor; the modification date is that of the
    version, or else that of the history.
    """
    item = F.col("item")
    rows = envelopes.select("space", "start", "limit", F.posexplode("results").alias("_n", "item"))
    body = [F.coalesce(item["body"]["storage"]["value"], F.lit("")).alias("body")] if with_body else []
    columns = [
        F.col("space"),
        (F.col("start") + F.col("_n")).alias("pos"),
        (F.floor(F.col("start") / F.col("limit")) + 1).cast("int").alias("api_page_number"),
        item["id"].alias("id"),
        item["title"].alias("title"),
        *body,
        item["version"]["number"].alias("version"),
        F.try_element_at(item["ancestors"], F.lit(-1))["id"].alias("parent_id"),
        timestamp(
            F.coalesce(_text(item["version"]["when"]), _text(item["history"]["lastUpdated"]["when"]))
        ).alias("modified_at"),
    ]
    return rows.select(*columns)


def scan_page_envelopes(spark: SparkSession, path: str, ends: DataFrame | None = None) -> DataFrame:
    """All pages of the landed listings, bodies included; ``ends`` as for :func:`envelope_cutoff`."""
    return flatten_page(envelope_cutoff(read_envelopes(spark, path), ends))


def scan_page_metadata(spark: SparkSession, path: str, ends: DataFrame | None = None) -> DataFrame:
    """All pages without their bodies."""
    return flatten_page(envelope_cutoff(read_envelopes(spark, path, with_body=False), ends), with_body=False)


def scan_search_results(pages: DataFrame, space: str, since: Column) -> DataFrame:
    """Pages of a space modified on or after the day of ``since``, latest first."""
    return pages.where((F.col("space") == space) & (F.col("modified_at") >= F.date_trunc("day", since))).orderBy(
        F.col("modified_at").desc(), "id"
    )


def scan_users(spark: SparkSession, path: str) -> DataFrame:
    """Users, one JSON object per line."""
    return spark.read.schema(USER).json(path).select(
        F.col("userKey").alias("user_key"), "username", F.col("displayName").alias("display_name"), "email"
    )


def scan_user_cache(spark: SparkSession, path: str) -> DataFrame:
    """User cache files: each one JSON object from user name, or ``key:`` and user key, to user."""
    cache = F.from_json("value", f"map<string,{USER.simpleString()}>")
    entries = spark.read.text(path, wholetext=True).select(F.explode(cache).alias("_key", "user"))
    by_key = F.col("_key").startswith("key:")
    return entries.select(
        F.when(by_key, "userkey").otherwise("username").alias("key_kind"),
        F.when(by_key, F.substring("_key", 5, 1 << 30)).otherwise(F.col("_key")).alias("key"),
        F.col("user.username").alias("username"),
        F.col("user.displayName").alias("display_name"),
        F.col("user.email").alias("email"),
    )


def _listed(files: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """Drop files in skipped folders, and hidden files and folders."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith("_"))
    skipped = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*skip))
    return files.where(~hidden & ~skipped)


def scan_html_tree(spark: SparkSession, root: str) -> DataFrame:
    """Stored page bodies: ``(path, id, html)``."""
    found = read_files(spark, root, ".html", _listed(list_files(spark, root, ".html"), ("images",)))
    return found.select("path", file_id(F.substring_index("path", "/", -1)).alias("id"), F.col("content").cast("string").alias("html"))


def scan_markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the Markdown files; contents are not read."""
    return _listed(list_files(spark, root, ".md"), ("images", "links")).select("path")


def scan_attachments(spark: SparkSession, root: str) -> DataFrame:
    """Attachments stored as ``<page id>/<file name>``."""
    path = F.split("path", "/")
    return read_files(spark, root).select(
        F.element_at(path, -2).alias("page_id"), F.element_at(path, -1).alias("filename"), F.col("content")
    )


def scan_meta_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Download state left beside the page files.

    As Spark reads JSON files: a list gives a row for each of its states, a
    file that is none a row of nulls, a file without any text no row.
    """
    listed = _listed(list_files(spark, root, ".meta.json"), ("images",))
    files = read_files(spark, root, ".meta.json", listed, json_text)
    text = F.col("content")
    states = F.when(text.rlike(r"^\s*\["), F.from_json(text, T.ArrayType(SIDECAR))).otherwise(F.array(F.from_json(text, SIDECAR)))
    rows = files.where(text.isNull() | text.rlike(r"\S")).select(
        "path", F.explode(F.coalesce(states, F.array(F.lit(None).cast(SIDECAR)))).alias("state")
    )
    return rows.select(
        "path",
        F.col("state.pageId").alias("page_id"),
        F.col("state.version").alias("version"),
        timestamp(F.col("state.modifiedDate")).alias("modified_at"),
        timestamp(F.col("state.downloadedAt")).alias("downloaded_at"),
    )
