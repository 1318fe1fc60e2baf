"""Stored intermediate tables.

Iterative operators and operators that read an intermediate result several
times write it once to the shared folder named by ``spark.checkpoint.dir`` and
read it back: the lineage is cut, the data survives the loss of executors, and
Catalyst sees the true size of what it joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Tables of the job that runs in this thread, if it drops them at its end.
_STORED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local session without the setting uses its warehouse."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def located(spark: SparkSession, path: str, make: bool = True) -> str | None:
    """``path`` with the scheme and host of the file system that Spark reads it by, links of a view file system followed.

    The folder is made, or else must be there already: without it the result is nothing.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if make:
        fs.mkdirs(folder)
    elif not fs.exists(folder):
        return None
    return fs.resolvePath(folder).toString()


def is_shared(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` names its file system or lies below the checkpoint folder or the warehouse, which a cluster's executors share."""
    if urlsplit(path).scheme:
        return True
    conf = getattr(spark, "conf", None)
    shared = [conf.get(key, None) for key in (CHECKPOINT_SETTING, "spark.sql.warehouse.dir")] if conf else []
    return any(f"{path}/".startswith(urlsplit(folder).path.rstrip("/") + "/") for folder in shared if folder)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders with all below them; those that don't exist are passed over."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored inside when the block ends; its results must be written elsewhere by then."""
    paths: list[str] = []
    token = _STORED.set(paths)
    try:
        yield
    finally:
        _STORED.reset(token)
        delete_paths(spark, paths)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _STORED.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
