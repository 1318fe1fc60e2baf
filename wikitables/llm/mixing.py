"""Mixing sources to target weights by Pareto order sampling.

DataFrame functions only.  Sources share all words by their weights; a source
is read at most MOST times over, and what it can't give is shared again by
weight (``filled``).  A source's target divided by its words is the number of
copies it expects of each document; a preference column, where given, makes
these numbers unequal inside a source.  The whole part of the number is certain
copies.  The rest is the probability p of one copy more, and the extra copies
are a Pareto order sample: a document with the random number u ranks by

    (u / (1 - u)) / (p / (1 - p)),

and the least ranks are taken until their words come nearest to what the
certain copies leave of the target.  The size of the sample is fixed in words,
so a source misses its target by half of one document at most.

The running sums are made over ranges of (source, rank): each range's words per
source are summed, and a sum over the ranges, a row each, shifts the sums inside
of them.  So a source that holds a third of all rows spans many tasks.

The random number is 52 bits of md5 of seed, id and text, so reruns agree.

Defined results: a null or empty text has no words and nothing is taken of it;
a null source is a source, the last; null ids are drawn by their texts; rows
with equal ids and texts share their draw and are rows of their own; where all
texts are empty all targets are 0; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import ranked
from .common import stored, table, whole_text

WEIGHTS = (1, 2, 3)
# A document's copies, and a source's words, at most.
MOST = 3
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def filled(items: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """(group, target, level) with sum(least(cap, level * weight)) = target over the items of each group.

    ``items`` has group, weight and cap, ``targets`` group and target.  The
    level rises from round to round, with the items above their cap held at it,
    until no further one reaches it.  A round is one aggregation with partial
    sums.  Groups without weight get no level.
    """
    levels = targets.select(group, "target", F.lit(None).cast("double").alias("level"))
    held = -1
    while True:
        now = levels.withColumnsRenamed({group: "_group", "level": "_level"}).select("_group", "_level")
        over = F.coalesce(F.col("_level") * F.col("weight") > F.col("cap"), F.lit(False))
        sums = (
            items.join(now, _same(F.col(group), F.col("_group")))
            .groupBy(group)
            .agg(
                F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("_capped"),
                F.sum(F.when(~over, F.col("weight")).otherwise(0)).alias("_open"),
                F.count_if(over).alias("_over"),
            )
            .withColumnRenamed(group, "_group")
        )
        levels = stored(
            targets.join(sums, _same(F.col(group), F.col("_group"))).select(
                group, "target", "_over", F.try_divide((F.col("target") - F.col("_capped")).cast("double"), F.col("_open").cast("double")).alias("level")
            ),
            "mix-levels",
        )
        over_now = levels.agg(F.sum("_over")).first()[0] or 0
        if over_now == held:
            return levels.drop("_over")
        held = over_now


def running_before(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before by ``order``, a total order."""
    ordering = [F.col(group), *(F.col(o) for o in order)]
    placed = stored(rows.repartitionByRange(*ordering).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    sums = placed.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shifts = sums.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(earlier, F.lit(0)).alias("_shift"))
    inside = F.sum(value).over(W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (
        placed.withColumn("_inside", F.coalesce(inside, F.lit(0)))
        .join(shifts, (F.col("_part") == F.col("_p")) & _same(F.col(group), F.col("_g")))
        .withColumn(out, F.col("_inside") + F.col("_shift"))
        .select(*rows.columns, out)
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` has source and source_size; adds weight and target."""
    numbered = ranked(sizes, [F.col("source").asc_nulls_last()], "number")
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    items = stored(
        numbered.select("source", "source_size", F.lit(0).alias("all"), cycle.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap")),
        "mix-sources",
    )
    whole = items.groupBy("all").agg(F.sum("source_size").alias("target"))
    level = filled(items, whole, "all").select("all", "level")
    share = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return items.join(level, "all").select("source", "source_size", "weight", share.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: str | None = None,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """id, size, source_size, target, source, copies and taken of each document.

    ``preference`` names a column of positive numbers: the expected copies of a
    source's documents are in proportion to it, up to ``most``.  Documents
    without one are not taken, nor is what a source can't give without them.
    """
    text = whole_text(text_col)
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    liking = F.lit(1.0) if preference is None else F.when(F.col(preference) > 0, F.col(preference).cast("double")).otherwise(0.0)
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            ((F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"),
            liking.alias("liking"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(source_targets(sizes, weights, most), "mix-targets")
    if preference is None:
        levels = sources.select(F.col("source").alias("_source"), "source_size", "target", F.try_divide("target", F.col("source_size").cast("double")).alias("level"))
    else:
        items = rows.select("source", (F.col("size") * F.col("liking")).alias("weight"), (F.lit(float(most)) * F.col("size")).alias("cap"))
        found = filled(items, sources.select("source", "target"), "source").select(F.col("source").alias("_level_source"), "level")
        levels = sources.join(found, _same(F.col("source"), F.col("_level_source")), "left").select(F.col("source").alias("_source"), "source_size", "target", "level")
    expected = F.coalesce(F.least(F.lit(float(most)), F.col("level") * F.col("liking")), F.lit(0.0))
    planned = stored(
        rows.join(levels, _same(F.col("source"), F.col("_source")))
        .withColumn("expected", expected)
        .withColumn("certain", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("certain"))
        .select("id", "source", "size", "source_size", "target", "u", "row", "certain", "p"),
        "mix-planned",
    )
    given = planned.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("given")).withColumnRenamed("source", "_source")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn_rows = planned.where("p > 0 and size > 0").withColumn("rank", odds)
    taking = (
        running_before(drawn_rows, "source", ["rank", "id", "row"], "size", "before")
        .join(given, _same(F.col("source"), F.col("_source")))
        .withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("given")).cast("long"))
        .drop("_source", "given", "before", "rank")
    )
    certain = planned.where("not (p > 0 and size > 0)").withColumn("extra", F.lit(0).cast("long"))
    out = taking.unionByName(certain).withColumn("copies", F.col("certain") + F.col("extra"))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.col("source").alias(source_col), "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  (('0x' || md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () AS whole, row_number() OVER (ORDER BY n::DOUBLE / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, (whole - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o),
v AS (SELECT min_by(level, k) AS level FROM l WHERE NOT level * w > 3 * n),
t AS (SELECT source, n AS source_size, least((3 * n)::DOUBLE, v.level * w) AS target FROM s, v),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS m FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(m)::BIGINT AS certain, m - floor(m) AS p FROM e),
r AS (SELECT *, sum(certain * size) OVER (PARTITION BY source) AS given,
             CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p),
b AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies
FROM (SELECT *, (certain + CASE WHEN rank IS NOT NULL AND before + size / 2.0::DOUBLE <= target - given THEN 1 ELSE 0 END)::BIGINT AS copies FROM b)
"""
