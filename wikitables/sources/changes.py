"""Tables of changes as a log of runs that is merged into sorted segments.

A run holds the rows of the keys it changes and, as tombstones, the keys it
removes.  Reading the table means finding each key's newest run, so without
care a read opens every run ever written.  ``compact`` merges neighbouring runs
into a segment sorted by key, in which each key has only its newest rows.  A
manifest lists the segments, oldest first; the runs after its last segment
count as they are.

**Which are merged.**  From the oldest segment on that has at most ``RATIO``
times the rows of all that follow it, everything is merged into one.  So after
a merge each segment has more than ``RATIO`` times the rows of all later ones:
there are at most log(rows) to base ``RATIO + 1`` of them, and a row is written
again at most log(rows) to base ``1 + 1 / RATIO`` times.

**Tombstones** stay while an older segment may hold rows of their key, and go
when the oldest segment takes part in the merge.

**Readers.**  A run counts once its row in the run table exists, a segment once
its manifest does.  Nothing is changed after that, so a reader stays on the
snapshot it has read; ``retire`` deletes only what the newest ``keep``
manifests don't need.  One job at a time writes, merges or retires.

Defined results: a key may have several rows in a run; of a run that writes and
removes a key the rows count; rows without a key are dropped; a table without a
finished run has no snapshot; merging fewer than two segments does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import delete_paths
from .sinks import RUNS, write_run

GONE, SEGMENTS, MANIFESTS = "gone", "segments", "manifests"
RATIO = 2


@dataclass(frozen=True)
class Segment:
    """The runs ``low`` to ``high``: merged in ``folder``, or a single run as it was written."""

    low: int
    high: int
    folder: str | None
    n_rows: int


@dataclass(frozen=True)
class Snapshot:
    """What a reader needs to know: the segments, oldest first, and the version of the manifest they come from."""

    version: int
    segments: tuple[Segment, ...]


def write_changes(
    rows: DataFrame, table: str, space: str, run_id: int, now: datetime, gone: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """Write ``rows`` as a run that also removes the keys in ``gone``."""
    keys = rows.sparkSession.createDataFrame([], rows.select(key).schema) if gone is None else gone.select(key)
    # An empty table replaces the tombstones of a run of this number that failed.
    keys.write.mode("overwrite").parquet(f"{table}/{GONE}/space={space}/run={run_id}")
    return write_run(rows, table, space, run_id, now)


def _manifests(spark: SparkSession, table: str, space: str) -> dict[int, list[Segment]]:
    """The manifests by version; each has a logarithmic number of rows, and ``retire`` removes old ones."""
    try:
        lines = spark.read.parquet(f"{table}/{MANIFESTS}/space={space}").orderBy("version", "low").collect()
    except AnalysisException:  # nothing was merged yet
        return {}
    found: dict[int, list[Segment]] = {}
    for r in lines:
        found.setdefault(r["version"], []).append(Segment(r["low"], r["high"], r["folder"], r["n_rows"]))
    return found


def _finished(spark: SparkSession, table: str, space: str, after: int) -> list[Segment]:
    """The finished runs after a number."""
    try:
        runs = spark.read.parquet(f"{table}/{RUNS}/space={space}")
    except AnalysisException:  # no run has finished yet
        return []
    rows = runs.where(F.col("run") > after).select("run_id", "total_rows").orderBy("run_id").collect()
    return [Segment(r["run_id"], r["run_id"], None, r["total_rows"]) for r in rows]


def read_snapshot(spark: SparkSession, table: str, space: str) -> Snapshot | None:
    manifests = _manifests(spark, table, space)
    version = max(manifests, default=0)
    merged = manifests.get(version, [])
    segments = (*merged, *_finished(spark, table, space, merged[-1].high if merged else -1))
    return Snapshot(version, segments) if segments else None


def _rows(spark: SparkSession, table: str, space: str, segments: tuple[Segment, ...], key: str) -> DataFrame:
    """The rows of segments with the number of the ``run`` that wrote them."""
    base, parts = f"{table}/space={space}", []
    if runs := [f"{base}/run={s.low}" for s in segments if s.folder is None]:
        parts.append(spark.read.option("basePath", base).parquet(*runs))
    if merged := [f"{table}/{SEGMENTS}/space={space}/{s.folder}/rows" for s in segments if s.folder is not None]:
        parts.append(spark.read.parquet(*merged))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.where(F.col(key).isNotNull())


def _tombstones(spark: SparkSession, table: str, space: str, segments: tuple[Segment, ...], like: DataFrame, key: str) -> DataFrame:
    """The keys that segments remove, with the ``run`` that does; ``like`` has the types."""
    schema = like.select(key, "run").schema
    found = spark.createDataFrame([], schema)
    if runs := [s.low for s in segments if s.folder is None]:
        try:
            kept = spark.read.schema(schema).parquet(f"{table}/{GONE}/space={space}")
            found = found.unionByName(kept.where(F.col("run").isin(runs)).select(key, "run"))
        except AnalysisException:  # runs without tombstones
            pass
    if merged := [f"{table}/{SEGMENTS}/space={space}/{s.folder}/gone" for s in segments if s.folder is not None]:
        found = found.unionByName(spark.read.parquet(*merged).select(key, "run"))
    return found.where(F.col(key).isNotNull())


def _newest(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Per key the newest run, and whether it has rows; only keys and numbers are shuffled."""
    marks = rows.select(key, "run", F.lit(True).alias("_has")).unionByName(gone.select(key, "run", F.lit(False).alias("_has")))
    return marks.groupBy(key).agg(F.max(F.struct("run", "_has")).alias("_last")).select(key, "_last.*")


def _live(rows: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    return rows.join(newest.where("_has").select(key, "run"), [key, "run"], "left_semi")


def read_current(
    spark: SparkSession, table: str, space: str, key: str = "id", only: DataFrame | None = None, snapshot: Snapshot | None = None
) -> DataFrame | None:
    """The state of the table: each key's rows of its newest run, with ``run``, unless that run removes the key.

    Rows of the oldest segment, which holds most, stay unless a later one names
    their key; only the keys of later segments are grouped.  With ``only``, a
    table of keys, the rows of these keys alone are found.  ``snapshot`` is
    what to read, by default what counts now.
    """
    snapshot = snapshot or read_snapshot(spark, table, space)
    if snapshot is None:
        return None

    def wanted(df: DataFrame) -> DataFrame:
        return df if only is None else df.join(only.select(key), key, "left_semi")

    oldest, later = snapshot.segments[:1], snapshot.segments[1:]
    first = wanted(_rows(spark, table, space, oldest, key))
    if not later:
        return first
    rows = wanted(_rows(spark, table, space, later, key))
    newest = _newest(rows, wanted(_tombstones(spark, table, space, later, rows, key)), key)
    return first.join(newest.select(key), key, "left_anti").unionByName(_live(rows, newest, key))


def first_to_merge(segments: tuple[Segment, ...], ratio: float = RATIO) -> int:
    """The place of the oldest segment that has at most ``ratio`` times the rows of all later ones."""
    start, after = len(segments) - 1, 0
    for n in range(len(segments) - 1, -1, -1):
        if after and segments[n].n_rows <= ratio * after:
            start = n
        after += segments[n].n_rows + 1
    return start


def compact(spark: SparkSession, table: str, space: str, key: str = "id", whole: bool = False, ratio: float = RATIO) -> Snapshot | None:
    """Merge the segments that are due, with ``whole`` all of them, and publish the new manifest; returns what counts then."""
    found = read_snapshot(spark, table, space)
    if found is None:
        return None
    start = 0 if whole else first_to_merge(found.segments, ratio)
    kept, chosen = found.segments[:start], found.segments[start:]
    if len(chosen) < 2:
        return found
    rows = _rows(spark, table, space, chosen, key)
    newest = _newest(rows, _tombstones(spark, table, space, chosen, rows, key), key)
    name = f"{chosen[0].low}-{chosen[-1].high}"
    folder = f"{table}/{SEGMENTS}/space={space}/{name}"
    live = _live(rows, newest, key).repartitionByRange(key).sortWithinPartitions(key)
    live.write.mode("overwrite").parquet(f"{folder}/rows")
    removed = newest.where(~F.col("_has") if kept else F.lit(False)).select(key, "run")
    removed.write.mode("overwrite").parquet(f"{folder}/gone")
    n_rows = spark.read.parquet(f"{folder}/rows").count() + spark.read.parquet(f"{folder}/gone").count()
    merged = Snapshot(found.version + 1, (*kept, Segment(chosen[0].low, chosen[-1].high, name, n_rows)))
    lines = [(s.low, s.high, s.folder, s.n_rows) for s in merged.segments]
    manifest = spark.createDataFrame(lines, "low bigint, high bigint, folder string, n_rows bigint")
    manifest.coalesce(1).write.parquet(f"{table}/{MANIFESTS}/space={space}/version={merged.version}")
    return merged


def retire(spark: SparkSession, table: str, space: str, keep: int = 2) -> list[str]:
    """Delete merged runs and segments that the newest ``keep`` manifests don't need; returns the folders.

    The state before the first merge counts as a manifest.  The newest run
    stays in any case.  A repeated call after a failure goes on.
    """
    if keep < 1:
        raise ValueError("the newest manifest has to stay")
    manifests = {0: []} | _manifests(spark, table, space)
    versions = sorted(manifests)
    kept, dropped = versions[-keep:], versions[:-keep]
    if kept[0] == 0:
        return []
    high = manifests[kept[0]][-1].high
    needed = {s for v in kept for s in manifests[v]}
    runs = _finished(spark, table, space, -1)
    old = [s.low for s in runs[:-1] if s.low <= high and s not in needed]
    segments = {s.folder for v in dropped for s in manifests[v] if s.folder} - {s.folder for s in needed}
    paths = [f"{table}/{SEGMENTS}/space={space}/{name}" for name in sorted(segments)]
    for kind in ("", f"{GONE}/", f"{RUNS}/"):  # the run's row goes last
        paths += [f"{table}/{kind}space={space}/run={n}" for n in old]
    paths += [f"{table}/{MANIFESTS}/space={space}/version={v}" for v in dropped if v]
    delete_paths(spark, paths)
    return paths
