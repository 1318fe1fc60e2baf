"""Index operators: diff, rebuild, queue, download state, on small hand-made cases."""

from datetime import datetime

from pyspark.sql import functions as F

from wikitables.functions import text as T
from wikitables.operators import index_ops as ix
from wikitables.schemas import PAGE_INDEX

NOW = datetime(2025, 11, 1)
D1, D2 = datetime(2025, 10, 1), datetime(2025, 10, 20)


def index(spark, *rows):
    """``(id, version, downloaded_version, downloaded_at, modified_at)``."""
    full = [(n, i, f"T{i}", v, None, m, D1, 1, dv, da) for n, (i, v, dv, da, m) in enumerate(rows)]
    return spark.createDataFrame(full, PAGE_INDEX)


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_diff_and_modes(spark):
    old = index(spark, ("same", 1, None, None, D1), ("up", 1, None, None, D1), ("gone", 1, None, None, D1), ("zero", 0, None, None, D1))
    new = index(spark, ("same", 1, None, None, D1), ("up", 2, None, None, D2), ("zero", 5, None, None, D2), ("fresh", 1, None, None, D2))
    full = by_id(ix.diff_snapshots(new, old), "change")
    assert full == {"same": "unchanged", "up": "updated", "gone": "deleted", "zero": "unchanged", "fresh": "new"}
    assert "gone" not in by_id(ix.diff_snapshots(new, old, mode="incremental"), "change")
    assert ix.update_summary(ix.diff_snapshots(new, old)).first() == (1, 1, 1, 4)


def test_rebuild_then_diff_finds_no_change(spark):
    old = index(spark, ("same", 1, 1, D1, D1), ("up", 1, 1, D1, D1), ("down", 3, 3, D1, D1), ("gone", 1, None, None, D1))
    new = index(spark, ("same", 1, None, None, D1), ("up", 2, None, None, D2), ("down", 2, None, None, D2), ("fresh", 1, None, None, D2))
    rebuilt = ix.rebuild_index(new, old, NOW)
    assert by_id(rebuilt, "version", "indexed_at", "downloaded_version") == {
        "same": (1, D1, 1), "up": (2, NOW, 1), "down": (2, NOW, 3), "fresh": (1, NOW, None),
    }
    assert by_id(ix.rebuild_index(new, old, NOW, carry_download_state=False), "downloaded_version") == {
        "same": 1, "up": None, "down": None, "fresh": None,
    }
    assert ix.diff_snapshots(ix.page_metadata(rebuilt), rebuilt).where("change <> 'unchanged'").isEmpty()


def test_upserts_agree(spark):
    old = index(spark, ("a", 1, None, None, D1), ("b", 1, None, None, D1))
    new = index(spark, ("b", 2, None, None, None), ("c", 1, None, None, D2))
    joined = by_id(ix.upsert_modified(old, new), "version", "modified_at")
    assert joined == by_id(ix.union_upsert(old, new), "version", "modified_at")
    assert joined == {"a": (1, D1), "b": (2, None), "c": (1, D2)}


def test_dedupe_last_value_first_position(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "a", 2)], "pos long, id string, version int")
    assert sorted(map(tuple, ix.dedupe_by_id(rows).collect())) == [(0, "a", 2), (1, "b", 1)]


def test_page_status_branches(spark):
    rows = index(
        spark, ("never", 3, None, None, D1), ("older", 3, 2, D1, D1), ("zero", None, 0, D1, D2), ("early", None, 0, D2, D1), ("same", 3, 3, D1, D2),
    )
    status = T.page_status(F.col("version"), F.col("downloaded_version"), F.col("downloaded_at"), F.col("modified_at"))
    got = {r["id"]: tuple(r["s"]) for r in rows.select("id", status.alias("s")).collect()}
    assert got == {
        "never": (True, "new", None),
        "older": (True, "updated", "v2 → v3"),
        "zero": (True, "updated", "modified after download"),
        "early": (False, "up-to-date", None),
        "same": (False, "up-to-date", None),
    }


def test_queue(spark, fx_index):
    assert ix.queue_status(fx_index, fx_index).select("queue_reason").distinct().collect() == [("new",)]
    done = ix.merge_download_state(fx_index, fx_index.select("id", "version").where("version > 1"), NOW)
    assert by_id(ix.page_statuses(done, done), "status") == {
        "100001": "new", "100002": "skip", "100003": "skip", "100004": "new", "100005": "new",
    }
    assert ix.queue_stats(ix.page_statuses(done, done), limit=2).first() == (3, 0, 2, 2, 5)
    assert ix.queue_status(done, done, force=True).count() == 5
    undated = index(spark, ("x", 1, 1, None, D1))
    assert by_id(ix.queue_status(undated, undated), "queue_reason") == {"x": "updated"}


def test_download_plan(spark):
    idx = index(spark, ("same", 2, 2, D1, D1), ("behind", 3, 2, D1, D1), ("lower", 1, 2, D1, D1), ("fresh", 1, None, None, D1), ("zero", None, 0, D1, D1))
    paths = spark.createDataFrame([("same", "out/a")], "id string, dir string")
    plan = ix.download_plan(idx, paths, idx, "out")
    assert by_id(plan, "action") == {"same": "skip", "behind": "update", "lower": "update", "fresh": "new", "zero": "skip"}
    assert by_id(plan, "dir")["same"] == "out/a" and by_id(plan, "dir")["fresh"] == "out"
    assert by_id(ix.download_plan(idx, paths, idx, "out", force=True), "action")["same"] == "update"
    assert ix.download_plan(idx.limit(0), paths, idx, "out").count() == 0


def test_merge_state_ignores_unknown_ids(spark):
    idx = index(spark, ("a", 1, None, None, D1), ("b", 1, 1, D1, D1))
    fetched = spark.createDataFrame([("a", None), ("zz", 4)], "id string, version int")
    assert by_id(ix.merge_download_state(idx, fetched, NOW), "downloaded_version", "downloaded_at") == {"a": (0, NOW), "b": (1, D1)}


def test_sidecars_last_path_wins(spark):
    idx = index(spark, ("a", 1, None, None, D1))
    side = spark.createDataFrame([("2.meta.json", "a", 7, D2), ("1.meta.json", "a", 6, D1), ("3.meta.json", "zz", 1, D1)],
                                 "path string, page_id string, version int, downloaded_at timestamp_ntz")
    merged, skipped = ix.merge_sidecars(idx, side)
    assert by_id(merged, "downloaded_version", "downloaded_at") == {"a": (7, D2)}
    assert [r["page_id"] for r in skipped.collect()] == ["zz"]
    assert ix.sidecar_stats(idx, side).first() == (2, 1)


def test_limit_counts_before_the_skip(spark):
    html = spark.createDataFrame([("o/a.html",), ("o/b.html",), ("o/c.html",)], "path string")
    md = spark.createDataFrame([("o/a.md",)], "path string")
    assert [r[0] for r in ix.files_to_process(html, md, 2).collect()] == ["o/b.html"]
    assert ix.files_to_process(html, md, 2, force=True).count() == 2


def test_lookup_and_missing(spark, fx_index):
    assert ix.point_lookup(fx_index, "100004").first()["title"] == "Child Page A"
    ids = spark.createDataFrame([("100001",), ("nope",)], "id string")
    assert [r[0] for r in ix.missing_ids(fx_index, ids).collect()] == ["nope"]
    assert ix.oldest_indexed(fx_index).first()[0] == datetime(2025, 10, 17, 10)


def test_batches(spark, fx_index):
    assert [r["batch_no"] for r in ix.batch_number(fx_index, 2).orderBy("pos").collect()] == [1, 1, 2, 2, 3]


def test_search_day_of_since(spark, fx_index):
    got = ix.search_results(fx_index, F.lit("2025-10-03 18:00:00").cast("timestamp_ntz")).collect()
    assert [r["id"] for r in got] == ["100005", "100004", "100003"]
