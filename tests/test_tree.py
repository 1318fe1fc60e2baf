"""Hierarchy operators, including cycles, orphans and hot parents."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wikitables.operators import tree
from wikitables.plans.ranking import ranked
from wikitables.plans.skew import spread_join
from wikitables.plans.storage import store


def make(spark, *rows):
    return spark.createDataFrame([(n, i, f"Title {i}", p) for n, (i, p) in enumerate(rows)], "pos long, id string, title string, parent_id string")


def order(df, by="ordinal"):
    return [r["id"] for r in df.orderBy(by).collect()]


def test_fixture_forest(fx_index):
    assert sorted(r["id"] for r in tree.root_pages(fx_index).collect()) == ["100001", "100003"]
    assert order(tree.preorder(fx_index)) == ["100001", "100002", "100005", "100004", "100003"]


def test_pages_fixture_paths(fx_pages):
    paths = {r["id"]: r["path"] for r in tree.page_paths(tree.with_names(fx_pages), "out/S").collect()}
    assert paths["200004"] == "out/S/200001-root-page/200002-child-1/200004-grandchild.html"
    assert paths["600001"] == "out/S/600001-index-page.html"


def test_cycles_and_orphans(spark):
    idx = make(spark, ("a", "b"), ("b", "a"), ("self", "self"), ("r", None), ("o", "zz"), ("k", "o"), ("under", "b"))
    forest = tree.build_forest(idx)
    assert order(tree.flatten_preorder(forest)) == ["r", "o", "k"]
    assert sorted(r["id"] for r in tree.cycle_pages(idx, forest).collect()) == ["a", "b", "self", "under"]
    chains = {r["id"]: r["ancestors"] for r in tree.ancestors(idx, forest, idx).collect()}
    assert chains == {"r": [], "o": [], "k": []}
    paths = {r["id"]: r["path"] for r in tree.page_html_path(idx, idx, "out").collect()}
    assert paths["k"] == "out/k-title-k.html"


def test_long_chain(spark):
    idx = make(spark, *[(f"n{i}", f"n{i - 1}" if i else None) for i in range(130)])
    deepest = tree.build_forest(idx).where("id = 'n129'").first()
    assert deepest["depth"] == 129 and deepest["ids"] == [f"n{i}" for i in range(130)]


def test_deep_forests_are_stored_in_blocks(spark, monkeypatch):
    """A chain with branches and a cycle: no stored table holds all ancestors of all pages."""
    rng = random.Random(7)
    rows = [("n0", None), *((f"n{i}", f"n{i - 1}") for i in range(1, 500)), *((f"b{i}", f"n{rng.randrange(500)}") for i in range(60))]
    rows += [("c0", "c9"), *((f"c{i}", f"c{i - 1}") for i in range(1, 10)), ("under", "c3")]
    parents, tables = dict(rows), []

    def kept(df, name):
        tables.append(store(df, name))
        return tables[-1]

    monkeypatch.setattr(tree, "store", kept)
    idx = make(spark, *rows)
    forest = tree.build_forest(idx, {"names": F.concat(F.lit("t"), F.col("id"))})
    held = [t.agg(F.sum(F.size("ids"))).first()[0] or 0 for t in tables if "ids" in t.columns]
    assert max(held) <= len(rows) * tree.BLOCK < 500 * 501 // 2
    places = {page: n for n, (page, _) in enumerate(rows)}
    for r in forest.collect():
        chain = [r["id"]]
        while parents[chain[0]] is not None:
            chain.insert(0, parents[chain[0]])
        assert (r["ids"], r["depth"], r["root_id"], r["is_root"]) == (chain, len(chain) - 1, "n0", len(chain) == 1)
        assert r["path"] == [places[c] for c in chain] and r["names"] == [f"t{c}" for c in chain]
    assert sorted(r["id"] for r in tree.cycle_pages(idx, forest).collect()) == sorted([*(f"c{i}" for i in range(10)), "under"])
    assert forest.count() == 560


def test_duplicate_ids_collapse(spark):
    idx = make(spark, ("r", None), ("x", None), ("x", "r"))
    assert order(tree.preorder(idx)) == ["r", "x"]
    assert tree.build_forest(idx).where("id = 'x'").first()["depth"] == 1


def test_subtree(spark):
    idx = make(spark, ("r", None), ("a", "r"), ("b", "a"), ("c", "r"))
    rows = {r["id"]: (r["depth"], r["path"]) for r in tree.find_subtree(tree.build_forest(idx), "a").collect()}
    assert rows == {"a": (0, [1]), "b": (1, [1, 2])}


def test_random_forest_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", rng.choice([None, "gone", *[f"p{rng.randrange(60)}" for _ in range(4)]])) for i in range(60)]
    parents, want = dict(rows), {}
    for page, _ in rows:
        chain, at = [], page
        while at in parents and at not in chain:
            chain.insert(0, at)
            at = parents[at]
        if at not in chain:
            want[page] = chain
    forest = tree.build_forest(make(spark, *rows))
    assert {r["id"]: r["ids"] for r in forest.collect()} == want
    assert sorted(order(tree.flatten_preorder(forest))) == sorted(want)


def test_nested_tree(spark):
    idx = make(spark, ("r", None), ("a", "r"))
    text = "\n".join(r["block"] for r in tree.nested_tree(tree.build_forest(idx)).orderBy("ordinal").collect())
    assert text == '- id: "r"\n  title: "Title r"\n  children:\n    - id: "a"\n      title: "Title a"\n      children: []'


def test_site_tree(spark):
    files = spark.createDataFrame([("b/x.md",), ("a.md",), ("b/c/y.md",)], "path string")
    assert [r["line"] for r in tree.sorted_site_tree(files).orderBy("ordinal").collect()] == [
        "# Documentation Links", "- **b/**", "  - **c/**", "    - [y.md](b/c/y.md)", "  - [x.md](b/x.md)", "- [a.md](a.md)",
    ]


def test_site_tree_orders_files_like_a_dictionary(spark):
    files = spark.createDataFrame([("Zoo.md",), ("apple.md",), ("Émile.md",), ("b/x.md",), ("Banana.md",)], "path string")
    want = ["b", "x.md", "apple.md", "Banana.md", "Émile.md", "Zoo.md"]

    def names(df):
        return [r["line"].strip(" -*[/").split("]")[0].rstrip("/*") for r in df.orderBy("ordinal").collect()][1:]

    assert names(tree.sorted_site_tree(files)) == want
    assert names(tree.sorted_site_tree(files, "UTF8_BINARY")) == ["b", "x.md", "Banana.md", "Zoo.md", "apple.md", "Émile.md"]


def test_ranking_over_many_partitions(spark):
    """One group holds a third of the rows and spans partitions."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("g"),
        (F.xxhash64("id") % 100000).alias("k"), "id",
    )
    for group in (["g"], None):
        whole = W.partitionBy(*group).orderBy("k", "id") if group else W.orderBy("k", "id")
        plain = rows.withColumn("n", F.row_number().over(whole).cast("bigint"))
        found = ranked(rows, ["k", "id"], "n", group)
        assert found.count() == 6000 and found.exceptAll(plain.select(*found.columns)).isEmpty()


def test_spread_join_equals_join(spark):
    facts = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise((F.col("id") % 90).cast("string")).alias("k")
    )
    dim = spark.range(80).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v")).union(spark.sql("SELECT 'hot', 7L"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        spread = spread_join(facts, dim, ["k"], how)
        plain = facts.join(dim, ["k"], how)
        assert spread.count() == plain.count()
        assert spread.select(*plain.columns).exceptAll(plain).isEmpty()


def test_forest_with_hot_parent(spark):
    """Two thirds of the pages have one parent."""
    rows = [("r", None)] + [(f"c{i}", "r" if i % 3 else f"c{i // 9 * 3 + 1}") for i in range(1, 300)]
    idx = make(spark, *rows)
    parents = dict(rows)
    want = {}
    for page in parents:
        want[page] = [page]
        while (up := parents[want[page][0]]) is not None:
            want[page].insert(0, up)
    forest = tree.build_forest(idx)
    assert {r["id"]: r["ids"] for r in forest.collect()} == want
    assert sorted(order(tree.flatten_preorder(forest))) == sorted(want)
    ranks = {r["id"]: r["sibling_rank"] for r in tree.sibling_rank(idx).collect()}
    assert ranks["c1"] == 1 and max(ranks.values()) == sum(1 for _, p in rows if p == "r")
