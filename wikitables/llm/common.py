"""What the operators share: input columns, stored intermediate tables, word patterns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# The white space of the contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's setting, else (local sessions only) the warehouse."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


# Parquet looks at a page's and a row group's size after 100 rows; where rows are large it must do so after each.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1,
    "parquet.block.size.row.check.max": 1, "parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false",
}


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, the rows survive lost executors, and Spark knows their
    size when it chooses joins.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows while the block runs, for jobs over rows of a megabyte."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has that column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as lists, each from about ``size`` bytes; bytes.split has that white space."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each."""
    lengths = pc.binary_length(texts).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        held += n or 0
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)
