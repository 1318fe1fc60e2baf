"""Interval labels of the page forest: raked leaves, Euler tour and list ranking.

Leaves are raked off in layers: a leaf's size goes to its parent, which may be a
leaf of the next layer.  A layer is taken only while it has a fourth of the
pages left, so all layers together cost as much as a few passes over the pages.
What stays, long chains and cycles, is the core.

Walking around the core enters and leaves each page once, children in listing
order.  The walk is a linked list of two steps per page: after entering a page
comes its first child, or leaving it; after leaving it comes its next sibling,
or leaving its parent.  List ranking by pointer jumping gives every step the
number of pages entered from it to the end, its depth and its root; a round
adds what the step that is pointed at knows and jumps to where that one points.
A page of the core counts with the pages raked off below it; those of them that
come after a page of the walk are taken off its place again.

A page's ``enter`` is its place in preorder, counted from 1, and ``leave`` the
place of the last page below it.  A raked page comes after its parent and the
sizes of its earlier siblings.  So the pages below a page are a range of
places, an ancestor test compares numbers, and storage is one row of fixed
width per page however deep the tree is.

Pages on or below a parent cycle never reach the end of the walk and are left
out.  Duplicate ids count once, as everywhere; siblings at one listing position
are ordered by id; an empty index gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import ranked, summed_before
from ..plans.skew import spread_join
from ..plans.storage import store
from .index_ops import dedupe_by_id

# Layers raked at most; the core has under a thirtieth of the pages then.
LAYERS = 12


def linked_pages(pages: DataFrame) -> DataFrame:
    """``(pos, id, up)``: ``up`` is the parent if it is a page.  ``pages`` has pos, id and parent_id, each id once."""
    present = pages.select(F.col("id").alias("parent_id"), F.lit(True).alias("_present"))
    linked = spread_join(pages.select("pos", "id", "parent_id"), present, ["parent_id"])
    return linked.select("pos", "id", F.when(F.col("_present"), F.col("parent_id")).alias("up"))


def rake(linked: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Layers ``(pos, id, up, size)`` of leaves, and the core ``(pos, id, up, weight)`` with the pages raked off below it counted, None if nothing stays."""
    pending, layers = store(linked.withColumn("weight", F.lit(1).cast("bigint")), "rake"), []
    left = pending.count()
    while left and len(layers) < LAYERS:
        parents = pending.where("up is not null").select(F.col("up").alias("id"), F.lit(True).alias("_above")).distinct()
        marked = store(pending.join(parents, "id", "left"), "rake-marked")
        leaves = marked.where("_above is null").select("pos", "id", "up", F.col("weight").alias("size"))
        taken = leaves.count()
        if 4 * taken < left:
            break
        layers.append(leaves)
        sums = leaves.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_below"))
        pending = store(
            marked.where("_above").join(sums, "id", "left").select("pos", "id", "up", (F.col("weight") + F.coalesce("_below", F.lit(0))).alias("weight")), "rake"
        )
        left -= taken
    return layers, pending if left else None


def euler_tour(core: DataFrame) -> DataFrame:
    """The steps ``(step, next, entered, change, shift, root)`` of the walk around the forest ``core``.

    ``core`` has pos, id, up, weight and shift.  ``entered``, ``change`` and
    ``shift`` are weight, 1 and shift for entering a page, 0, -1 and -shift for
    leaving it; ``root`` is the page that leaving it ends a tree with.  Roots are
    siblings.
    """
    siblings = store(ranked(core, ["pos", "id"], "rank", ["up"]), "siblings")
    following = siblings.select(F.col("up").alias("_up"), (F.col("rank") - 1).alias("_rank"), F.col("id").alias("sibling"))
    # Roots have no parent to hash by, so each is matched by its place alone.
    inner = siblings.where("up is not null").join(following.where("_up is not null"), (F.col("up") == F.col("_up")) & (F.col("rank") == F.col("_rank")), "left")
    roots = siblings.where("up is null").join(following.where("_up is null"), F.col("rank") == F.col("_rank"), "left")
    first = siblings.where("up is not null and rank = 1").select(F.col("up").alias("id"), F.col("id").alias("child"))
    walk = inner.unionByName(roots).select("id", "up", "sibling", "weight", "shift").join(first, "id", "left")
    down, up = (lambda c: F.concat(F.lit("d"), c)), (lambda c: F.concat(F.lit("u"), c))
    entering = F.struct(
        down(F.col("id")).alias("step"), F.coalesce(down(F.col("child")), up(F.col("id"))).alias("next"),
        F.col("weight").alias("entered"), F.lit(1).cast("bigint").alias("change"), F.col("shift").alias("shift"), F.lit(None).cast("string").alias("root"),
    )
    leaving = F.struct(
        up(F.col("id")).alias("step"), F.coalesce(down(F.col("sibling")), up(F.col("up"))).alias("next"),
        F.lit(0).cast("bigint").alias("entered"), F.lit(-1).cast("bigint").alias("change"), (-F.col("shift")).alias("shift"), F.when(F.col("up").isNull(), F.col("id")).alias("root"),
    )
    return walk.select(F.explode(F.array(entering, leaving)).alias("s")).select("s.*")


def ranked_steps(steps: DataFrame) -> DataFrame:
    """``steps`` with the sums of entered, change and shift and the first root from each step to the end; steps that reach none are left out.

    Every round doubles how far a pointer reaches; the steps it brings to the
    end are those of a stretch twice as long as the one before, so a round that
    brings none proves that only cycles are left.
    """
    steps = store(steps, "tour")
    finished, pending, left = steps.where("next is null"), steps.where("next is not null"), None
    sums = ("entered", "change", "shift")
    while True:
        remaining = pending.count()
        if remaining in (0, left):
            return finished.drop("next")
        left = remaining
        ahead = finished.unionByName(pending).select(
            F.col("step").alias("next"), F.col("next").alias("_next"), *(F.col(c).alias(f"_{c}") for c in sums), F.col("root").alias("_root")
        )
        moved = store(
            pending.join(ahead, "next").select(
                "step", F.col("_next").alias("next"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums), F.coalesce("root", "_root").alias("root")
            ),
            "tour-round",
        )
        finished = finished.unionByName(moved.where("next is null"))
        pending = moved.where("next is not null")


def _core_labels(core: DataFrame, before: DataFrame) -> DataFrame:
    """``(pos, id, up, size, enter, leave, depth, root_id)`` of the core's pages that reach a root; ``before`` has the raked pages below earlier siblings of each id."""
    raked = core.select(F.col("id").alias("up"), (F.col("weight") - 1).alias("_raked"))
    shifted = core.join(before.select("id", "before"), "id").join(raked, "up", "left")
    core = store(shifted.select("pos", "id", "up", "weight", (F.coalesce("_raked", F.lit(0)) - F.col("before")).alias("shift")), "core")
    ranks = store(ranked_steps(euler_tour(core)), "tour-ranks")
    total = ranks.agg(F.max("entered")).first()[0] or 0
    entering = ranks.where(F.col("step").startswith("d")).select(
        F.substring("step", 2, 1 << 30).alias("id"), F.col("entered").alias("_from"), F.col("shift").alias("_shift"), (-F.col("change")).cast("int").alias("depth"), F.col("root").alias("root_id")
    )
    leaving = ranks.where(F.col("step").startswith("u")).select(F.substring("step", 2, 1 << 30).alias("id"), F.col("entered").alias("_upto"))
    size, enter = F.col("_from") - F.col("_upto"), total + 1 - F.col("_from") - F.col("shift") + F.col("_shift")
    labels = core.join(entering, "id").join(leaving, "id")
    return store(labels.select("pos", "id", "up", size.alias("size"), enter.alias("enter"), (enter + size - 1).alias("leave"), "depth", "root_id"), "core-labels")


def label_intervals(index: DataFrame) -> DataFrame:
    """The index columns with ``enter``, ``leave``, ``depth`` and ``root_id`` of each page that reaches a root."""
    pages = store(dedupe_by_id(index), "interval-pages")
    layers, core = rake(linked_pages(pages))
    sized = [layer.withColumn("layer", F.lit(k)) for k, layer in enumerate(layers)]

    def placed(of_core: list[DataFrame]) -> DataFrame:
        rows = [*sized, *(c.select("pos", "id", "up", "size", F.lit(-1).alias("layer")) for c in of_core)]
        together = rows[0]
        for more in rows[1:]:
            together = together.unionByName(more)
        return store(summed_before(together, ["pos", "id"], "size", "before", ["up"]), "placed")

    labelled, of_core = None, []
    columns = ["id", "enter", "leave", "depth", "root_id"]
    if core is not None:
        of_core = [_core_labels(core, placed([core.withColumn("size", F.lit(0).cast("bigint"))]))]
        labelled = of_core[0].select(*columns)
    elif not layers:
        return store(pages.select(*pages.columns, *(F.lit(None).cast(t).alias(c) for c, t in zip(columns[1:], ("bigint", "bigint", "int", "string")))), "intervals")
    places = placed(of_core) if layers else None
    for k in reversed(range(len(layers))):
        layer = places.where(F.col("layer") == k)
        enter = F.col("before") + 1
        tops = layer.where("up is null").select("id", enter.alias("enter"), (enter + F.col("size") - 1).alias("leave"), F.lit(0).alias("depth"), F.col("id").alias("root_id"))
        if labelled is None:
            labelled = store(tops, "layer")
            continue
        above = labelled.select(F.col("id").alias("up"), F.col("enter").alias("_enter"), (F.col("depth") + 1).alias("depth"), "root_id")
        enter = F.col("_enter") + enter
        inner = layer.where("up is not null").join(above, "up").select("id", enter.alias("enter"), (enter + F.col("size") - 1).alias("leave"), "depth", "root_id")
        labelled = labelled.unionByName(store(tops.unionByName(inner), "layer"))
    return store(pages.join(labelled, "id").select(*pages.columns, *columns[1:]), "intervals")


def write_intervals(labels: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Store labels clustered by ``enter``: files and row groups hold ranges of places, which readers skip by their statistics."""
    labels.repartitionByRange("enter").sortWithinPartitions("enter").write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return labels.sparkSession.read.schema(labels.schema).parquet(path)


def subtree(labels: DataFrame, page_id: str) -> DataFrame:
    """A page and everything below it, with depth counted from that page: one range of places, pushed down to the scan."""
    top = labels.where(F.col("id") == page_id).select("enter", "leave", "depth").first()
    if top is None:
        return labels.limit(0)
    return labels.where(F.col("enter").between(top["enter"], top["leave"])).withColumn("depth", F.col("depth") - top["depth"])


def preorder(labels: DataFrame) -> DataFrame:
    """The forest in depth-first order: ``ordinal`` is the place itself, nothing is sorted."""
    return labels.withColumn("ordinal", F.col("enter")).drop("enter", "leave")


def is_below(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(id, above)`` with ``below``: whether ``above`` is an ancestor of ``id``; two joins by id, at any depth."""
    lower = labels.select("id", F.col("enter").alias("_at"))
    upper = labels.select(F.col("id").alias("above"), F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    inside = (F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_to"))
    return spread_join(spread_join(pairs, lower, ["id"]), upper, ["above"]).withColumn("below", F.coalesce(inside, F.lit(False))).drop("_at", "_from", "_to")
