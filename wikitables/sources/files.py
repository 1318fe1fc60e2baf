"""Files below a folder, listed and read by tasks: the driver never holds their names."""

from __future__ import annotations

import json
import os
import re
import sys
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import checkpoint_folder, located, store

# Entries that a task of the first round lists before it passes its other folders on; twice as many in each round.
FIRST_ROUND = 20_000
# Folders that a task remembers to list itself.
KEPT_FOLDERS = 10_000
# Bytes that a task reads, each file counted with the bytes that could be read while it is opened.
SHARE, OPENING = 64 << 20, 16 << 10
# A batch of files ends at either.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000

# What tasks run goes to them whole, as a nested function would: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def opened(place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a :func:`located` folder, and the folder's path there."""
    if place.startswith("file:"):  # Hadoop's own spelling of local paths, file:/x, is none that Arrow knows
        return pafs.LocalFileSystem(), re.sub("^file:(//[^/]*)?", "", place).rstrip("/")
    fs, base = pafs.FileSystem.from_uri(place)
    return fs, base.rstrip("/")


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """``(name, whether it is a folder, bytes)`` of what lies in ``folder``; those of a local folder are never held together."""
    if not isinstance(fs, pafs.LocalFileSystem):
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.type == pafs.FileType.Directory, info.size or 0
        return
    with os.scandir(folder or "/") as found:
        for entry in found:
            try:
                row = entry.name, entry.is_dir(), entry.stat().st_size
            except FileNotFoundError:  # a link to nothing
                continue
            yield row


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def json_text(data: bytes) -> str | None:
    """A JSON file's text, whichever of its encodings it is in; nothing if it is in none."""
    try:
        return data.decode(json.detect_encoding(data))
    except UnicodeDecodeError:
        return None


def _tree_path(spark: SparkSession, root: str) -> Column:
    """Path below ``root`` of the file a row was read from."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(folder)
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # Without scheme and host, which the two spell differently.
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.substring(plain, len(full.toUri().getPath().rstrip("/")) + 2, 1 << 30)


def _place(spark: SparkSession, root: str) -> str | None:
    """``root`` as :func:`opened` takes it; nothing if only Spark knows its file system, or rows found can't be stored."""
    place = located(spark, root, make=False)
    if place is None:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    try:
        checkpoint_folder(spark)
        opened(place)
    except (pa.ArrowException, NotImplementedError, OSError, ValueError):
        return None
    return place


def _by_spark(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(_tree_path(spark, root).alias("path"), F.col("length").alias("bytes"), "content")


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """The files below ``root`` whose names end in ``suffix``, hidden ones and those in hidden folders aside: ``(path, bytes)``.

    Each round deals the folders found so far to tasks.  A task lists its
    folders and those below until it has seen so many entries, and passes on
    the folders it did not come to.  Rows are stored as they are found.  File
    systems that Arrow does not know are listed by Spark's driver, as are all
    on a cluster without a shared folder.
    """
    place = _place(spark, root)
    if place is None:
        return _by_spark(spark, root, suffix).drop("content")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = opened(place)
            paths: list[str] = []
            sizes: list[int | None] = []  # none for a folder that is still to be listed
            seen = 0

            def rows() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])
                paths.clear()
                sizes.clear()
                return out

            for start in (path for batch in batches for path in batch.column(0).to_pylist()):
                folders = deque([start])
                while folders:
                    folder = folders.popleft()
                    if seen >= most:
                        paths.append(folder)
                        sizes.append(None)
                    else:
                        for name, is_folder, size in _entries(fs, f"{base}/{folder}".rstrip("/")):
                            seen += 1
                            if _hidden(name) or not is_folder and not name.endswith(suffix):
                                continue
                            path = f"{folder}/{name}" if folder else name
                            if is_folder and len(folders) < KEPT_FOLDERS:
                                folders.append(path)
                                continue
                            paths.append(path)
                            sizes.append(None if is_folder else size)
                            if len(paths) >= BATCH_ROWS:
                                yield rows()
                    if len(paths) >= BATCH_ROWS:
                        yield rows()
            yield rows()

        return run

    found, most = [], FIRST_ROUND
    todo = spark.range(1, numPartitions=1).select(F.lit("").alias("path"))
    while True:
        listed = store(todo.mapInArrow(walk(most), "path string, bytes bigint"), "listing")
        found.append(listed.where(F.col("bytes").isNotNull()))
        waiting = listed.where(F.col("bytes").isNull()).select("path")
        if waiting.isEmpty():
            break
        todo, most = waiting.repartition(tasks), 2 * most
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def read_files(
    spark: SparkSession, root: str, suffix: str = "", listed: DataFrame | None = None, text: Callable[[bytes], str | None] | None = None
) -> DataFrame:
    """The files below ``root``, or those of them that are ``listed``, with what they hold: ``(path, bytes, content)``.

    They are dealt to tasks by number and size.  ``text`` makes a text of a
    file's bytes; without it the content is binary.
    """
    listed = list_files(spark, root, suffix) if listed is None else listed
    place = _place(spark, root)
    if place is None:
        files = _by_spark(spark, root, suffix).join(listed.select("path"), "path", "left_semi")
        return files if text is None else files.withColumn("content", F.udf(lambda data: text(bytes(data)))("content"))
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    tasks = max(1, least, -(-(size + n * OPENING) // SHARE))
    kind = pa.binary() if text is None else pa.string()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(place)
        paths: list[str] = []
        sizes: list[int] = []
        contents: list[bytes | str | None] = []

        def rows() -> pa.RecordBatch:
            columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, kind)]
            for column in (paths, sizes, contents):
                column.clear()
            return pa.RecordBatch.from_arrays(columns, ["path", "bytes", "content"])

        held = 0
        for path in (path for batch in batches for path in batch.column(0).to_pylist()):
            with fs.open_input_file(f"{base}/{path}") as file:
                data = file.read()
            paths.append(path)
            sizes.append(len(data))
            contents.append(data if text is None else text(data))
            held += len(data)
            if held >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                yield rows()
                held = 0
        yield rows()

    kept = "string" if text else "binary"
    return listed.select("path").repartition(tasks).mapInArrow(read, f"path string, bytes bigint, content {kept}")
