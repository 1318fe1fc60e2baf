"""Writers: run-versioned state tables and files per page."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import spread_join
from ..plans.storage import delete_paths, is_shared, located
from .files import opened

RUNS = "runs"


def write_run(df: DataFrame, table: str, space: str, run_id: int, now: datetime, page_size: int | None = None) -> DataFrame:
    """Write one run of a state table and then its row in the run table, which makes it current.

    A run that fails before its row is written is never read, and writing the
    same run again replaces it.
    """
    spark = df.sparkSession
    data = f"{table}/space={space}/run={run_id}"
    df.write.mode("overwrite").parquet(data)
    rows = spark.read.parquet(data).agg(F.count(F.lit(1)).alias("total_rows"))
    run = rows.select(
        F.lit(space).alias("space"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(now).cast("timestamp_ntz").alias("export_date"),
        F.lit(page_size).cast("int").alias("page_size"),
        "total_rows",
    )
    run.coalesce(1).write.mode("overwrite").parquet(f"{table}/{RUNS}/space={space}/run={run_id}")
    return run


def read_runs(spark: SparkSession, table: str, space: str) -> DataFrame | None:
    """The finished runs of a table, or nothing when there are none."""
    try:
        return spark.read.parquet(f"{table}/{RUNS}/space={space}").drop("run")
    except AnalysisException:  # no run has finished yet
        return None


def latest_run(spark: SparkSession, table: str, space: str) -> int | None:
    runs = read_runs(spark, table, space)
    return None if runs is None else runs.agg(F.max("run_id")).first()[0]


def read_latest(spark: SparkSession, table: str, space: str) -> DataFrame | None:
    """The newest finished run of a table."""
    run_id = latest_run(spark, table, space)
    return None if run_id is None else spark.read.parquet(f"{table}/space={space}/run={run_id}")


def retire_runs(spark: SparkSession, table: str, space: str, keep: int = 2) -> list[str]:
    """Delete the rows of all but the newest ``keep`` runs of a table whose every run is a whole state; their entries in the run table go last."""
    runs = read_runs(spark, table, space)
    numbers = [] if runs is None else sorted(r["run_id"] for r in runs.select("run_id").collect())
    old = numbers[: -max(keep, 1)]
    paths = [f"{table}/{kind}space={space}/run={n}" for kind in ("", f"{RUNS}/") for n in old]
    delete_paths(spark, paths)
    return paths


def write_index(index: DataFrame, table: str, space: str, run_id: int, now: datetime, page_size: int = 100) -> DataFrame:
    return write_run(index, table, space, run_id, now, page_size)


def write_queue(queue: DataFrame, table: str, space: str, run_id: int, now: datetime) -> DataFrame:
    return write_run(queue, table, space, run_id, now)


def write_tree(forest: DataFrame, table: str, space: str, run_id: int, now: datetime) -> DataFrame:
    """The forest as an adjacency list with paths."""
    return write_run(forest.select("id", "parent_id", "title", "root_id", "depth", "path"), table, space, run_id, now)


def write_files(df: DataFrame, root: str) -> DataFrame:
    """Write each row ``(path, content)`` to a file below ``root``; returns ``(path, bytes)``.

    Every task writes its own rows, through whichever file system ``root``
    names; without a scheme that is Spark's default one, and outside a local
    session the folder must be one that executors share, below
    ``spark.checkpoint.dir`` or the warehouse.  A file is written under a name
    of its own and then renamed, so what has its final name is whole, and a
    repeated task does no harm.  The action runs when the result is used.
    """
    spark = df.sparkSession
    if not spark.sparkContext.master.startswith("local[") and not is_shared(spark, root):
        raise ValueError(f"name a shared file system for {root}, such as hdfs:// or file:// on a shared disk")
    place = located(spark, root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(place)
        folders: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in folders:
                    fs.create_dir(folder, recursive=True)
                    folders.add(folder)
                unfinished = f"{folder}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(unfinished) as out:
                    out.write(content)
                fs.move(unfinished, target)
                sizes.append(len(content))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    return df.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(write, "path string, bytes bigint")


def html_files(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Page bodies with their place in the folder tree: ``(path, id, html)``."""
    return pages.select("id", "html").join(paths.select("id", "path"), "id").select("path", "id", "html")


def write_html(pages: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    return write_files(html_files(pages, paths).withColumnRenamed("html", "content"), root)


def markdown_files(markdown: DataFrame, paths: DataFrame) -> DataFrame:
    """Markdown rows with the path of their file."""
    return markdown.join(paths.select("id", "dir"), "id").select(F.concat_ws("/", "dir", "file").alias("path"), "id", "markdown")


def write_markdown(markdown: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """One file per page."""
    return write_files(markdown_files(markdown, paths).select("path", F.col("markdown").alias("content")), root)


def image_files(resolved: DataFrame, paths: DataFrame) -> DataFrame:
    """Found images by target path, one per path: ``(path, content)``.

    Pages of one folder share its ``images`` folder; of several images with one
    name the first by page and position stays.
    """
    folders = paths.select(F.col("id").alias("page_id"), "dir")
    placed = spread_join(resolved.where("found"), folders, ["page_id"], "inner")
    named = placed.select(
        F.concat_ws("/", "dir", F.lit("images"), "slug_name").alias("path"), "page_id", "pos", "content"
    )
    # Names choose; contents move once, to the winners.
    won = named.groupBy("path").agg(F.min(F.struct("page_id", "pos")).alias("_first")).select("path", "_first.*")
    return named.join(won, ["path", "page_id", "pos"], "left_semi").select("path", "content")


def write_images(resolved: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    return write_files(image_files(resolved, paths), root)
