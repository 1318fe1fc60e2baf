"""Logs of runs and their segments against plain dictionaries, what they read, and what upkeep of a job's tables leaves."""

import math
import os
import random
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from wikitables.sources import changes, sinks
from wikitables.sync import CHANGES, SyncOptions, current_table, maintain, sync_corpus

from test_sources import envelope, land, page

NOW = datetime(2025, 11, 1)
ROWS = "id string, n int, text string"


def written(spark, table, run, rows, gone=()):
    keys = spark.createDataFrame([(g,) for g in gone], "id string")
    changes.write_changes(spark.createDataFrame(rows, ROWS), table, "S", run, NOW, keys)


def state(df):
    return sorted(((r["id"], r["n"], r["text"], r["run"]) for r in df.collect()), key=str)


def test_random_runs(spark, tmp_path):
    """Runs of random writes and removals, merged and retired now and then, hold what a dictionary holds; older snapshots stay readable."""
    rng, table = random.Random(5), str(tmp_path / "log")
    model, pinned = {}, []
    for run in range(1, 10):
        size = rng.choice([0, 2, 5, 40])
        rows = [(f"p{rng.randrange(60)}", n, f"text {run} é") for n in range(size)]
        gone = {f"p{rng.randrange(60)}" for _ in range(rng.randrange(6))}
        written(spark, table, run, rows, gone)
        for g in gone:
            model.pop(g, None)
        fresh = {}
        for i, n, text in rows:
            fresh.setdefault(i, []).append((i, n, text, run))
        model |= fresh
        wanted = sorted((r for rows in model.values() for r in rows), key=str)
        if run % 3 == 0:
            before = changes.read_snapshot(spark, table, "S")
            after = changes.compact(spark, table, "S")
            for n, s in enumerate(after.segments[:-1] if after != before else ()):
                assert s.n_rows > changes.RATIO * sum(later.n_rows for later in after.segments[n + 1 :])
            changes.retire(spark, table, "S", keep=2)
            pinned = [*pinned[-1:], (after, wanted)]
            for snapshot, then in pinned:
                assert state(changes.read_current(spark, table, "S", snapshot=snapshot)) == then
        if run % 3 != 1:
            assert state(changes.read_current(spark, table, "S")) == wanted
    some = spark.createDataFrame([("p1",), ("p7",), ("absent",)], "id string")
    assert state(changes.read_current(spark, table, "S", only=some)) == [r for r in wanted if r[0] in ("p1", "p7")]
    whole = changes.compact(spark, table, "S", whole=True)
    assert len(whole.segments) == 1 and whole.segments[0].n_rows == len(wanted)  # no tombstone is left
    assert state(changes.read_current(spark, table, "S")) == wanted


def test_few_segments_and_small_merges(spark):
    """Of many runs of one size a logarithm stays, and a row is merged again a logarithm of times."""
    for ratio in (1, 2, 4):
        segments, moved = [], 0
        for run in range(2000):
            segments.append(changes.Segment(run, run, None, 100))
            start = changes.first_to_merge(tuple(segments), ratio)
            if start < len(segments) - 1:
                n = sum(s.n_rows for s in segments[start:])
                moved += n
                segments[start:] = [changes.Segment(segments[start].low, run, "x", n)]
        total = 2000 * 100
        assert len(segments) <= 1 + math.log(total, ratio + 1) and moved <= total * math.log(total, 1 + 1 / ratio)


def test_small_runs_leave_the_base_alone(spark, tmp_path):
    """A merge of small runs doesn't write the base again, a read takes base and segments only, rows lie in the order of their keys."""
    table = str(tmp_path / "log")
    spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("n"), F.lit("t").alias("text")).createOrReplaceTempView("many")
    changes.write_changes(spark.table("many"), table, "S", 1, NOW)
    for run in range(2, 6):
        written(spark, table, run, [(str(run), run, "new")], [str(100 + run)])
    after = changes.compact(spark, table, "S")
    assert [(s.low, s.high, s.folder) for s in after.segments] == [(1, 1, None), (2, 5, "2-5")]
    current = changes.read_current(spark, table, "S")
    files = {os.path.dirname(f) for f in current.inputFiles()}
    assert sum("/run=" in f and "/gone/" not in f for f in files) == 1 and not any("run=3" in f for f in files)
    assert current.count() == 4996 and current.where("n > 1").count() == 4
    merged = spark.read.parquet(f"{table}/segments/space=S/2-5/rows")
    assert [r["id"] for r in merged.collect()] == ["2", "3", "4", "5"]
    assert spark.read.parquet(f"{table}/segments/space=S/2-5/gone").count() == 4  # the base still has rows of these


def test_odd_logs(spark, tmp_path):
    """No runs, a single run, runs without rows, a failed run's tombstones, rows without a key, clashing names, runs written without tombstones."""
    table = str(tmp_path / "log")
    assert changes.read_current(spark, table, "S") is None and changes.compact(spark, table, "S") is None
    assert changes.retire(spark, table, "S") == []
    sinks.write_run(spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("", 3, "")], ROWS), table, "S", 1, NOW)
    assert state(changes.read_current(spark, table, "S")) == [("", 3, "", 1), ("a", 1, "x", 1)]
    assert changes.compact(spark, table, "S").version == 0
    spark.createDataFrame([("a",)], "id string").write.parquet(f"{table}/gone/space=S/run=2")  # of a run that failed
    assert len(state(changes.read_current(spark, table, "S"))) == 2
    written(spark, table, 2, [])
    written(spark, table, 3, [("a", 4, "rows win")], ["a", "", None])
    assert state(changes.read_current(spark, table, "S")) == [("a", 4, "rows win", 3)]
    assert changes.compact(spark, table, "S", whole=True).version == 1
    assert state(changes.read_current(spark, table, "S")) == [("a", 4, "rows win", 3)]
    written(spark, table, 4, [], ["a"])
    changes.compact(spark, table, "S", whole=True)
    assert state(changes.read_current(spark, table, "S")) == []
    changes.retire(spark, table, "S", keep=1)
    assert sorted(os.listdir(f"{table}/segments/space=S")) == ["1-4"] and sinks.latest_run(spark, table, "S") == 4
    assert state(changes.read_current(spark, table, "S")) == []
    named = spark.createDataFrame([("a", 1, 2, 3)], "id string, _has int, _last int, version int")
    clash = str(tmp_path / "clash")
    for run in (1, 2):
        changes.write_changes(named, clash, "S", run, NOW)
    changes.compact(spark, clash, "S", whole=True)
    assert changes.read_current(spark, clash, "S").collect()[0].asDict() == {"id": "a", "_has": 1, "_last": 2, "version": 3, "run": 2}


def test_upkeep_of_a_job(spark, tmp_path, no_users):
    """Syncs with changed, new and removed pages and upkeep in between give what one sync of the last listing gives."""
    o = SyncOptions(space="S", landing="", tables=str(tmp_path / "t"), now=NOW)
    listings = [
        {1: 1, 2: 1, 3: 1, 4: 1},
        {1: 1, 2: 2, 3: 1, 5: 1},
        {1: 3, 2: 2, 4: 1, 5: 1},  # page 4 comes back
    ]
    for n, listing in enumerate(listings):
        items = [page(i, v, body=f"<p>body {i} {v}</p>") for i, v in listing.items()]
        o = replace(o, landing=land(tmp_path / f"in{n}", "a.json", envelope(0, items, limit=10, more=False)))
        sync_corpus(spark, o, no_users)
        counts = maintain(spark, o, keep=1 + n % 2)
        assert set(counts) == set(CHANGES) and all(0 < c <= 3 for c in counts.values())
    other = replace(o, tables=str(tmp_path / "once"))
    sync_corpus(spark, other, no_users)
    for table, column in (("html", "html"), ("markdown", "markdown")):
        one, all_at_once = (sorted((r["id"], r[column]) for r in current_table(spark, x, table).collect()) for x in (o, other))
        assert one == all_at_once and len(one) == 4
        assert sorted(r["id"] for r in changes.read_current(spark, f"{o.tables}/{table}", "S").collect()) == ["1", "2", "4", "5"]
    assert sinks.read_runs(spark, f"{o.tables}/queue", "S").count() <= 2
