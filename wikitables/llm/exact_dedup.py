"""Exact deduplication: group by a 128-bit content hash, keep one stable row, compare bytes inside groups.

DataFrame functions only.  Hashes are counted with partial aggregation, so a
group that holds a third of all rows arrives as one row per task.  Only groups
of two or more rows are stored, and only their texts are compared, byte for
byte, with the text of the row that stays; both joins are plain equi-joins
whose hot keys adaptive execution splits.  Rows whose bytes differ from the
kept row's (a hash collision) are grouped anew by their bytes.

Defined results: a null text is an empty text; a null id is an id like any
other and stays only if no row of its group has one; of rows with equal id,
length and text exactly one stays; an empty table gives an empty table; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, stored, table, unused_name, whole_text


def content_hash(text: Column) -> Column:
    """128 bits of the bytes."""
    return F.unhex(F.md5(text))


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and _row, its number in ``docs``.

    Texts are equal when identical without white space.  Of equal texts the row
    with the most code points stays, then the smallest id.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.length(text).alias("n"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_replace(text, BLANK + "+", "").alias("bytes"),
    ).withColumn("hash", hashed(F.col("bytes")))
    # The least of these stays.
    rank = F.struct((-F.col("n")).alias("neg_n"), F.col("id").isNull().alias("no_id"), "id", "row")
    groups = stored(
        rows.groupBy("hash").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1),
        "copies",
    )
    # Both joins shuffle at any size, as they will at scale; only the second moves texts.
    digest = F.sha2("bytes", 256).alias("text_sha256")
    thin = rows.select("hash", "id", "row", digest)
    single = thin.join(groups.hint("merge"), "hash", "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row"
    )

    members = stored(rows.join(groups.hint("merge"), "hash").select("hash", "id", "n", "row", "best", "size", "bytes"), "members")
    keepers = members.where(F.col("row") == F.col("best.row")).select("hash", F.col("bytes").alias("keeper"))
    compared = members.join(keepers, "hash").withColumn("same", F.col("bytes") == F.col("keeper"))
    collided = stored(compared.where(~F.col("same")).select("hash", "id", "n", "row", "bytes"), "collided")
    fewer = collided.groupBy("hash").agg(F.count(F.lit(1)).alias("fewer"))
    copies = (
        members.join(collided.select("row"), "row", "left_anti")
        .join(fewer, "hash", "left")
        .select(
            "id",
            F.col("best.id").alias("keep_id"),
            (F.col("size") - F.coalesce("fewer", F.lit(0))).cast("long").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"),
            digest,
            "row",
        )
    )
    regrouped = collided.groupBy("hash", "bytes").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size"))
    apart = collided.join(regrouped, ["hash", "bytes"]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        digest,
        "row",
    )
    out = single.unionByName(copies).unionByName(apart)
    return out.withColumnsRenamed({"id": id_col, "row": "_row"})


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  ``docs`` must be a stored table: it is read again."""
    gone = classify(docs, id_col, text_col).where(~F.col("kept")).select("_row")
    number = unused_name(docs, "_row")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    return numbered.join(gone.withColumnRenamed("_row", number), number, "left_anti").select(*(docs[c] for c in docs.columns))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).drop("_row")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
