"""State tables in hash buckets: a batch of changes rewrites the buckets it touches, and no others.

Rows belong to the bucket their id hashes to; the number of buckets is fixed
when a table is made.  A run writes new versions of the buckets it touches and
then its manifest, which names the run that holds each bucket.  A run counts
from the moment its manifest exists.  Versions are never changed, so a reader
stays on the manifest it has read, and a run that failed is simply written
again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """The run a table has come to, its number of buckets, and the run that wrote each bucket in use."""

    run: int
    buckets: int
    written: dict[int, int]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifests(table: str, space: str) -> str:
    return f"{table}/manifests/space={space}"


def read_manifest(spark: SparkSession, table: str, space: str, run: int | None = None) -> Manifest | None:
    """The manifest of a run, of the newest by default; at most one row per bucket reaches the driver."""
    try:
        rows = spark.read.parquet(_manifests(table, space))
    except AnalysisException:  # no run has finished yet
        return None
    run = rows.agg(F.max("run")).first()[0] if run is None else run
    found = rows.where(F.col("run") == run).collect()
    return Manifest(run, found[0]["buckets"], {r["bucket"]: r["written"] for r in found if r["bucket"] is not None})


def read_state(
    spark: SparkSession, table: str, space: str, schema: StructType, manifest: Manifest | None = None, only: set[int] | None = None
) -> DataFrame:
    """The rows as of a manifest, the newest by default; ``only`` names the buckets to read."""
    manifest = manifest or read_manifest(spark, table, space)
    written = {} if manifest is None else manifest.written
    paths = [f"{table}/space={space}/run={run}/bucket={b}" for b, run in sorted(written.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched_buckets(changes: DataFrame, buckets: int, key: str = "id") -> set[int]:
    """The buckets of the changed keys: a set of ``buckets`` numbers at most."""
    return {r[0] for r in changes.select(bucket_of(F.col(key), buckets)).distinct().collect()}


def write_state(
    rows: DataFrame, table: str, space: str, run: int, touched: set[int], before: Manifest | None, buckets: int = BUCKETS, key: str = "id"
) -> Manifest:
    """Write ``rows``, all that the ``touched`` buckets hold now, as ``run`` and publish its manifest."""
    spark = rows.sparkSession
    buckets = before.buckets if before else buckets
    data = f"{table}/space={space}/run={run}"
    placed = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    held = {r[0] for r in spark.read.parquet(data).select("bucket").distinct().collect()} if touched else set()
    written = {b: r for b, r in (before.written if before else {}).items() if b not in touched} | dict.fromkeys(held, run)
    lines = [(buckets, b, r) for b, r in sorted(written.items())] or [(buckets, None, None)]
    manifest = spark.createDataFrame(lines, "buckets int, bucket int, written bigint")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{_manifests(table, space)}/run={run}")
    return Manifest(run, buckets, written)
