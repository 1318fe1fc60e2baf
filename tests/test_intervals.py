"""Interval labels against plain recursion, on deep chains, cycles and odd input."""

import random

from pyspark.sql import functions as F

from wikitables.operators import intervals, tree

COLUMNS = "pos long, id string, title string, parent_id string"


def expected(rows):
    """{id: (enter, leave, depth, root)} by walking the forest."""
    ids = {r[1] for r in rows}
    children = {}
    for pos, page, _, parent in sorted(rows):
        children.setdefault(parent if parent in ids else None, []).append(page)
    out, place = {}, 0
    stack = [(p, 0, p, False) for p in reversed(children.get(None, []))]
    while stack:
        page, depth, root, left = stack.pop()
        if left:
            out[page] = (out[page][0], place, depth, root)
            continue
        place += 1
        out[page] = (place, None, depth, root)
        stack.append((page, depth, root, True))
        stack += [(c, depth + 1, root, False) for c in reversed(children.get(page, []))]
    return out


def found(labels):
    return {r["id"]: (r["enter"], r["leave"], r["depth"], r["root_id"]) for r in labels.collect()}


def test_random_forests(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), f"p{n}", "t", rng.choice([None, "gone", *(f"p{k}" for k in range(max(n - 9, 0), n))])) for n in range(120)]
    rows += [(1, "c1", "t", "c2"), (2, "c2", "t", "c1"), (3, "c3", "t", "c2"), (4, "own", "t", "own")]  # on and below cycles
    labels = intervals.label_intervals(spark.createDataFrame(rows, COLUMNS))
    want = expected(rows)
    assert found(labels) == want and "c3" not in want
    for page in ("p0", "p7", "p119"):
        below = {p: d - want[page][2] for p, (e, _, d, _) in want.items() if want[page][0] <= e <= want[page][1]}
        assert {r["id"]: r["depth"] for r in intervals.subtree(labels, page).collect()} == below
    assert intervals.subtree(labels, "c1").count() == 0
    pairs = spark.createDataFrame([(f"p{rng.randrange(120)}", f"p{rng.randrange(120)}") for _ in range(300)] + [("c1", "p1"), ("p1", "c1")], "id string, above string")
    for r in intervals.is_below(labels, pairs).collect():
        known = r["id"] in want and r["above"] in want
        assert r["below"] == (known and want[r["above"]][0] < want[r["id"]][0] <= want[r["above"]][1])


def test_agrees_with_the_forest_of_arrays(spark, fx_index):
    order = {r["id"]: r["ordinal"] for r in tree.preorder(fx_index).collect()}
    assert {r["id"]: r["ordinal"] for r in intervals.preorder(intervals.label_intervals(fx_index)).collect()} == order


def test_deep_chain_is_linear_and_ranges_are_pushed_down(spark, tmp_path):
    """A chain of 100,000 pages: one row of fixed width each; a subtree is a range that the scan gets."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    labels = intervals.write_intervals(intervals.label_intervals(chain), str(tmp_path / "labels"), 10_000)
    wrong = labels.where((F.col("enter") != F.col("pos") + 1) | (F.col("leave") != n) | (F.col("depth") != F.col("pos")) | (F.col("root_id") != "0"))
    assert labels.count() == n and wrong.isEmpty()
    below = intervals.subtree(labels, str(n - 500))
    assert below.count() == 500 and "GreaterThanOrEqual(enter," in below._jdf.queryExecution().executedPlan().toString()
    assert below.select(F.input_file_name()).distinct().count() == 1


def test_no_pages(spark):
    assert intervals.label_intervals(spark.createDataFrame([], COLUMNS)).count() == 0


def test_few_passes_over_a_bushy_forest_and_small_cores(spark, monkeypatch):
    """Raked layers leave the walk only what is no bush: nothing, or a chain and a cycle with pages raked off beside them."""
    walked = []
    tour = intervals.euler_tour
    monkeypatch.setattr(intervals, "euler_tour", lambda core: walked.append(core.count()) or tour(core))
    rng = random.Random(8)
    bush = [(n % 7, f"p{n}", "t", f"p{(n - 1) // 4}" if n else None) for n in range(400)]
    assert found(intervals.label_intervals(spark.createDataFrame(bush, COLUMNS))) == expected(bush) and not walked
    chain = [(rng.randrange(9), f"k{n}", "t", f"k{n - 1}" if n else rng.choice(["p3", None])) for n in range(60)]
    hung = [(rng.randrange(9), f"h{n}", "t", rng.choice([None, "x1", "gone", f"k{rng.randrange(60)}", f"p{rng.randrange(400)}"])) for n in range(150)]
    rows = bush + chain + hung + [(1, "x1", "t", "x2"), (2, "x2", "t", "x1")]
    assert found(intervals.label_intervals(spark.createDataFrame(rows, COLUMNS))) == expected(rows)
    assert len(walked) == 1 and walked[0] < len(rows) / 4
