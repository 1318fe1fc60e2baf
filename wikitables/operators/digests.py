"""Digest trees: two states of a page table are compared by sums over hash ranges, and by rows only where the sums differ.

An id belongs to the range that the first bits of its hash name.  A snapshot is
written with a folder per range and with a tree of digests: the number of rows
of each range and the sums of two hashes of (id, version), which depend on
neither order nor file layout.  A range's digest is the sum of its halves', so
each level of the tree is a sum over the level below it.

Two snapshots are compared from the top: a level looks only at what lies below
the unequal ranges of the level above, down to the ranges with a folder.  What
differs there is compared by the smallest ranges, the leaves.  Rows outside
unequal leaves are dropped before the join and, where a whole folder is equal,
never read.  So rows joined follow the number of changes, rows read the number
of folders with a change: a listing without changes reads digests alone.

The driver holds numbers of unequal folders, 2 ** ``Shape.stored`` at most;
leaves stay in tables.  Equal digests of unequal ranges need sums of 128 bits
of hash to collide.

Defined results: ids are unique in a snapshot (``dedupe_by_id``); a row without
an id takes no part; null and 0 are the same missing version, as for
``diff_snapshots``; an empty table has no digests and equals another one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index_ops import diff_snapshots, given

_SUMS = ["n_rows", "a_low", "a_high", "b_low", "b_high"]


@dataclass(frozen=True)
class Shape:
    """Bits of the ranges; both snapshots of a comparison have the same shape."""

    stored: int = 6  # of the ranges that have a folder each
    leaves: int = 16  # of the smallest ranges: some hundred rows a leaf is a good size
    step: int = 3  # that a level goes down

    def __post_init__(self) -> None:
        if not (0 < self.step and self.stored % self.step == 0 and 0 < self.stored < self.leaves < 40):
            raise ValueError(f"stored is a multiple of step and leaves has more bits than stored: {self}")

    def levels(self) -> list[int]:
        """The levels above the leaves, the top one first."""
        return list(range(self.step, self.stored + 1, self.step))


def range_of(key: Column, bits: int) -> Column:
    """The range of an id among 2 ** ``bits``."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def leaf_digests(rows: DataFrame, bits: int) -> DataFrame:
    """(range, number of rows, sums) of the ranges in use; sums of 32-bit halves can't overflow."""
    hashed = rows.where(F.col("id").isNotNull()).select(
        range_of(F.col("id"), bits).alias("range"),
        *(F.xxhash64(F.lit(salt), "id", F.coalesce(given(F.col("version")), F.lit(0))).alias(salt) for salt in ("a", "b")),
    )
    low = F.lit(0xFFFFFFFF)
    halves = [f(F.col(s)).alias(f"{s}_{name}") for s in ("a", "b") for name, f in (("low", lambda c: c.bitwiseAND(low)), ("high", lambda c: F.shiftrightunsigned(c, 32)))]
    return hashed.select("range", F.lit(1).cast("long").alias("n_rows"), *halves).groupBy("range").agg(*(F.sum(c).alias(c) for c in _SUMS))


def write_snapshot(rows: DataFrame, path: str, shape: Shape = Shape()) -> None:
    """Write ``rows`` in folders by range, and then their digests, which make the snapshot whole."""
    spark = rows.sparkSession
    placed = rows.where(F.col("id").isNotNull()).withColumn("folder", range_of(F.col("id"), shape.stored))
    placed.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    leaf_digests(written, shape.leaves).write.mode("overwrite").parquet(f"{path}/digests/level={shape.leaves}")
    below = shape.leaves
    for level in reversed(shape.levels()):
        summed = _level(spark, path, below).groupBy(F.shiftright("range", below - level).alias("range")).agg(*(F.sum(c).alias(c) for c in _SUMS))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{path}/digests/level={level}")
        below = level


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("range long, " + ", ".join(f"{c} long" for c in _SUMS)).parquet(f"{path}/digests/level={level}")


def _unequal(spark: SparkSession, one: str, other: str, level: int, above: list[int] | None, shift: int) -> DataFrame:
    """Ranges of a level, below the ranges ``above``, whose digests differ or that one side lacks."""
    sides = [_level(spark, path, level) for path in (one, other)]
    if above is not None:
        sides = [s.where(F.shiftright("range", shift).isin(above)) for s in sides]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    same = F.lit(True)
    for c in _SUMS:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, F.col("a.range") == F.col("b.range"), "full_outer").where(~same).select(F.coalesce("a.range", "b.range").alias("range"))


def unequal_folders(spark: SparkSession, one: str, other: str, shape: Shape = Shape()) -> list[int]:
    """The folders in which two snapshots differ."""
    found: list[int] | None = None
    for level in shape.levels():
        found = sorted(r[0] for r in _unequal(spark, one, other, level, found, shape.step).collect())
        if not found:
            break
    return found or []


def suspects(spark: SparkSession, path: str, folders: list[int], leaves: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Id, title and version of a snapshot's rows in unequal leaves; only the folders named are read."""
    rows = spark.read.schema("id string, title string, version int, folder long").parquet(f"{path}/rows")
    placed = rows.where(F.col("folder").isin(folders)).withColumn("range", range_of(F.col("id"), shape.leaves))
    return placed.join(leaves, "range", "left_semi").select("id", "title", "version")


def diff_trees(spark: SparkSession, current: str, index: str, shape: Shape = Shape()) -> DataFrame:
    """New, updated and deleted pages between two written snapshots, as ``diff_snapshots`` reports them."""
    folders = unequal_folders(spark, current, index, shape)
    leaves = _unequal(spark, current, index, shape.leaves, folders, shape.leaves - shape.stored)
    c, i = (suspects(spark, path, folders, leaves, shape) for path in (current, index))
    return diff_snapshots(c, i).where(F.col("change") != "unchanged")
