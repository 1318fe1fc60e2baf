"""Digest trees against the full comparison, and what they read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wikitables.operators import digests
from wikitables.operators import index_ops as ix

COLUMNS = "pos long, id string, title string, version int"
SHAPE = digests.Shape(stored=4, leaves=9, step=2)


def frame(spark, rows):
    return spark.createDataFrame([(n, i, f"t{i}", v) for n, (i, v) in enumerate(rows.items())], COLUMNS)


def changes(df):
    return {tuple(r) for r in df.select("id", "title", "old_version", "new_version", "change").collect()}


def compared(spark, folder, current, index):
    """The differences of two snapshots."""
    for name, rows in (("current", current), ("index", index)):
        digests.write_snapshot(rows.repartition(3), f"{folder}/{name}", SHAPE)
    return digests.diff_trees(spark, f"{folder}/current", f"{folder}/index", SHAPE)


def test_random_changes(spark, tmp_path):
    rng = random.Random(3)
    state = {f"p{n}": rng.choice([None, 0, 1, 2, 3]) for n in range(300)}
    for turn in range(3):
        after = {i: rng.choice([v, None, 0, 4, 9]) if rng.random() < 0.1 else v for i, v in state.items() if rng.random() > 0.05 * turn}
        after |= {f"n{turn}-{k}": k for k in range(3 * turn)}
        current, index = frame(spark, after), frame(spark, state)
        found = changes(compared(spark, str(tmp_path / str(turn)), current, index))
        assert found == changes(ix.diff_snapshots(current, index).where("change <> 'unchanged'"))
        assert found
        state = after


def test_levels_are_sums_and_forget_the_order(spark, tmp_path):
    rows = frame(spark, {f"p{n}": n % 5 for n in range(200)})
    digests.write_snapshot(rows, str(tmp_path / "a"), SHAPE)
    digests.write_snapshot(rows.orderBy(F.desc("pos")).repartition(7), str(tmp_path / "b"), SHAPE)
    for level in [*SHAPE.levels(), SHAPE.leaves]:
        tables = [sorted(map(tuple, digests._level(spark, str(tmp_path / s), level).collect())) for s in "ab"]
        wanted = sorted(map(tuple, digests.leaf_digests(rows, level).collect()))
        assert tables == [wanted, wanted] and sum(r[1] for r in wanted) == 200


def test_reads_follow_the_changes(spark, tmp_path):
    """Of 20,000 pages one changes: one folder is read, and of it the rows of one leaf go on; without a change none."""
    pages = spark.range(20_000).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(1).alias("version"))
    changed = pages.withColumn("version", F.when(F.col("id") == "77", 2).otherwise(F.col("version")))
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    digests.write_snapshot(pages, one)
    digests.write_snapshot(changed, other)
    assert changes(digests.diff_trees(spark, other, one)) == {("77", "t", 1, 2, "updated")}
    folders = digests.unequal_folders(spark, other, one)
    shape = digests.Shape()
    leaves = digests._unequal(spark, other, one, shape.leaves, folders, shape.leaves - shape.stored)
    rows = digests.suspects(spark, one, folders, leaves)
    assert len(folders) == 1 and leaves.count() == 1 and 1 <= rows.count() < 20
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+L? = %d" % folders[0], rows._jdf.queryExecution().executedPlan().toString())
    assert digests.unequal_folders(spark, one, one) == [] and digests.diff_trees(spark, one, one).isEmpty()


def test_odd_rows(spark, tmp_path):
    """No pages, pages without an id, missing versions, columns with clashing names."""
    empty, some = frame(spark, {}), frame(spark, {"a": None, "é 中": 0, "": 3})
    assert compared(spark, str(tmp_path / "1"), empty, empty).isEmpty()
    assert changes(compared(spark, str(tmp_path / "2"), some, empty)) == {("a", "ta", None, None, "new"), ("é 中", "té 中", None, 0, "new"), ("", "t", None, 3, "new")}
    assert {c[-1] for c in changes(compared(spark, str(tmp_path / "3"), empty, some))} == {"deleted"}
    missing = frame(spark, {"a": 0, "é 中": None, "": 3}).union(spark.createDataFrame([(9, None, "t", 1)], COLUMNS))
    assert compared(spark, str(tmp_path / "4"), missing, some).isEmpty()
    named = some.withColumn("range", F.lit(1)).withColumn("n_rows", F.lit(5)).withColumn("a_low", F.lit("x"))
    assert compared(spark, str(tmp_path / "5"), named, some).isEmpty()
    with pytest.raises(ValueError):
        digests.Shape(stored=5, leaves=9, step=2)
