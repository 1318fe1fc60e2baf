"""Sharding by fixed virtual slots: records hash into slots, a versioned map sends slots to shards.

DataFrame functions only.  The number of slots is a parameter that does not
grow with the data, so the sums per slot and the map are small tables of proven
size: the map is edited on the driver and broadcast.  Records are dealt by the
hash of their id, so neither a hot source nor a large group of copies shares a
slot.  A record's number in its shard is the count of the records in earlier
slots of that shard plus its number within its slot: no task sorts a shard.

The map has versions.  A call on a folder that holds one uses the newest, and
asked for more shards edits it, one shard a version: slots move only into the
shard that is new, so all other records stay where they are.

Defined results: a null text has no bytes; a record without an id is dealt by
the hash of its text; rows with equal ids share a slot and get different
numbers; an empty table gives an empty table; other columns are ignored,
whatever their names.  Fewer shards, or another number of slots, than the newest
map has are an error.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_folder, table, whole_text

SLOTS = 4096


def slot_of(id_column: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot, from 32 bits of a hash that every engine has: of the id, or of the text of a record without one."""
    digest = F.md5(F.coalesce(id_column.cast("string"), text))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots


def slot_sizes(sized: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot in use; at most one entry per virtual slot."""
    sums = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in sums.collect()}


def balanced_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: the largest slot goes to the emptiest shard, again and again."""
    heap = [(0, 0, s) for s in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, (0, 0))[0], v)):
        filled, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (filled + sizes.get(slot, (0, 0))[0], held + 1, shard))
    return shard_of


def grown_map(shard_of: list[int], sizes: dict[int, tuple[int, int]]) -> list[int]:
    """The map edited for one more shard: slots move only into the new shard, the fullest shard giving first."""
    new = max(shard_of) + 1
    size = {v: sizes.get(v, (0, 0))[0] for v in range(len(shard_of))}
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(new)}
    for slot, shard in enumerate(shard_of):
        held[shard].append((size[slot], slot))
    filled = {s: sum(n for n, _ in slots) for s, slots in held.items()}
    for slots in held.values():
        slots.sort()
    target, taken, out = sum(filled.values()) / (new + 1), 0, list(shard_of)
    heap = [(-filled[s], s) for s in held]
    heapq.heapify(heap)
    while heap:
        _, shard = heapq.heappop(heap)
        # The largest slot that leaves the giving shard, and the new one, at its share.
        spare = min(filled[shard] - target, target - taken)
        at = bisect_right(held[shard], (spare, len(shard_of))) - 1
        if at < 0 or spare <= 0:
            continue
        given, slot = held[shard].pop(at)
        out[slot] = new
        taken += given
        filled[shard] -= given
        heapq.heappush(heap, (-filled[shard], shard))
    return out


def save_map(spark: SparkSession, shard_of: list[int], folder: str, version: int) -> None:
    """Write one version of the map; a version is never changed once written."""
    frame = spark.createDataFrame(list(enumerate(shard_of)), "virtual_slot long, shard int")
    frame.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[int]]:
    """A version of the map, the newest by default."""
    frame = spark.read.parquet(folder)
    version = frame.agg(F.max("version")).first()[0] if version is None else version
    rows = frame.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return version, [r["shard"] for r in rows]


def sized_rows(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual_slot of each record."""
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        slot_of(F.col(id_col), text, slots).alias("virtual_slot"),
    )


def assign(sized: DataFrame, shard_of: list[int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Add shard and slot, the record's number in its shard (gapless from 0)."""
    held, rows = [0] * (max(shard_of) + 1), []
    for virtual, shard in enumerate(shard_of):
        rows.append((virtual, shard, held[shard]))
        held[shard] += sizes.get(virtual, (0, 0))[1]
    slot_map = sized.sparkSession.createDataFrame(rows, "virtual_slot long, shard int, before long")
    number = F.row_number().over(W.partitionBy("virtual_slot").orderBy("id", "text_crc32"))
    return (
        sized.withColumn("number", number)
        .join(F.broadcast(slot_map), "virtual_slot")
        .withColumn("slot", F.col("before") + F.col("number") - 1)
        .drop("before", "number")
    )


def current_map(spark: SparkSession, folder: str, shards: int, slots: int, sizes: dict[int, tuple[int, int]]) -> list[int]:
    """The newest map of a folder, edited for more shards if need be; without one a new map, saved as version 1.

    Each edit adds one shard and is a version of its own.
    """
    try:
        version, shard_of = load_map(spark, folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        version, shard_of = 1, balanced_map(sizes, shards, slots)
        save_map(spark, shard_of, folder, version)
    held = max(shard_of) + 1
    if len(shard_of) != slots or held > shards:
        raise ValueError(f"the map in {folder} has {len(shard_of)} slots and {held} shards")
    for version in range(version + 1, version + 1 + shards - held):
        shard_of = grown_map(shard_of, sizes)
        save_map(spark, shard_of, folder, version)
    return shard_of


def shard_documents(
    docs: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Every record with its shard, by a map that evens out bytes.

    With ``folder`` the newest map there is used, edited if it has fewer shards;
    if there is none, the new one becomes version 1.
    """
    spark = docs.sparkSession
    sized = sized_rows(docs, slots, id_col, text_col)
    sizes = slot_sizes(sized)
    shard_of = balanced_map(sizes, shards, slots) if folder is None else current_map(spark, folder, shards, slots, sizes)
    return assign(sized, shard_of, sizes).withColumnRenamed("id", id_col)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 under the law ``bytes``; each run keeps its map as version 1 in a folder of its own."""
    import uuid

    folder = f"{scratch_folder(spark)}/llm-slot-map-{uuid.uuid4().hex}"
    out = shard_documents(table(spark, sf_dir, "documents"), 16, folder=folder)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
