"""Row numbers without sending a whole group, or the whole table, to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import store

# monotonically_increasing_id has the partition above these bits and the row within it below.
_ROW_BITS = 33


def ranked(df: DataFrame, order: list[str | Column], out: str, group: list[str] | None = None) -> DataFrame:
    """Add ``out``: the 1-based position of each row within ``group`` by ``order``, a total order within the group.

    The table is sorted once over range partitions and stored with each row's
    place in its partition.  The rows of earlier partitions, one number per
    partition, shift that to a place in the whole table; a group's first place
    shifts it to a place in the group.  A group of any size spans tasks, and
    the plan is the same for every size.
    """
    group = group or []
    ordering = [*(F.col(g) for g in group), *(F.col(o) if isinstance(o, str) else o for o in order)]
    sorted_rows = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    placed = store(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn(
        "_part", F.shiftright("_at", _ROW_BITS)
    )
    running = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(running, F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        "_place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    first = F.lit(0)
    if group:
        starts = numbered.groupBy(*(F.col(g).alias(f"_group_{g}") for g in group)).agg(F.min("_place").alias("_first"))
        same = [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group]
        numbered, first = numbered.join(starts, same), F.col("_first")
    return numbered.select(*df.columns, (F.col("_place") - first + 1).cast("bigint").alias(out))


def summed_before(df: DataFrame, order: list[str], weight: str, out: str, group: list[str]) -> DataFrame:
    """Add ``out``: the sum of ``weight``, none negative, of the rows before each row within ``group`` by ``order``.

    As :func:`ranked`: sums run within range partitions, and one number per
    partition and the first sum of a group shift them, so a group spans tasks.
    """
    ordering = [F.col(c) for c in (*group, *order)]
    at, names = df.columns.index(weight), [*df.columns, "_within", "_part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            weights = batch.column(at).to_numpy()
            sums = total + np.cumsum(weights)
            total = int(sums[-1]) if len(sums) else total
            added = [pa.array(sums - weights), pa.array(np.full(len(sums), part, np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    schema = T.StructType([*df.schema.fields, T.StructField("_within", T.LongType()), T.StructField("_part", T.LongType())])
    placed = store(df.repartitionByRange(*ordering).sortWithinPartitions(*ordering).mapInArrow(run, schema), "summed")
    running = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy("_part").agg(F.sum(weight).alias("_n")).select("_part", F.coalesce(running, F.lit(0)).alias("_earlier"))
    whole = placed.join(F.broadcast(offsets), "_part").withColumn("_sum", F.col("_earlier") + F.col("_within"))
    starts = whole.groupBy(*(F.col(g).alias(f"_group_{g}") for g in group)).agg(F.min("_sum").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group]
    return whole.join(starts, same).select(*df.columns, (F.col("_sum") - F.col("_first")).cast("bigint").alias(out))
