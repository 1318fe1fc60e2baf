"""Incremental upkeep: bucketed state whatever the landing order, and Markdown equal to a full conversion after every change."""

import os
import random
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from tests.test_sources import envelope, land, page
from wikitables.operators import refs
from wikitables.operators.refs import MarkdownOptions
from wikitables.sources import buckets, sinks
from wikitables.streaming import streams
from wikitables.sync import SyncOptions, current_table, sync_corpus, transform_stored

NOW = datetime(2025, 11, 1)


def include(n):
    return f'<ac:structured-macro ac:name="include"><ri:page ri:content-title="Page {n}" /></ac:structured-macro>'


def children(n=None):
    inner = "" if n is None else f'<ri:page ri:content-title="Page {n}" />'
    return f'<ac:structured-macro ac:name="children">{inner}</ac:structured-macro>'


def link(n):
    return f'<p><ac:link><ri:page ri:content-title="Page {n}" /></ac:link></p>'


def test_landing_order_does_not_matter(spark, tmp_path):
    """Batches of one file in two orders give one index; a batch rewrites the buckets of its pages alone."""
    rng = random.Random(3)
    files = []
    for k in range(3):
        items = [page(n, version=rng.randint(1, 5), when=f"2025-10-{rng.randint(1, 28):02}T10:00:00Z") for n in rng.sample(range(14), 6)]
        files.append(envelope(k * 6, items, limit=6))
    found = []
    for t, order in enumerate(([0, 1, 2], [2, 1, 0])):
        table = str(tmp_path / f"t{t}")
        for n, k in enumerate(order):
            landing = land(tmp_path / f"in{t}", f"{n}.json", files[k])
            streams.stream_index_upsert(spark, landing, str(tmp_path / f"p{t}"), table, "S", NOW, buckets=16).awaitTermination()
            written = {d for d in os.listdir(f"{table}/space=S/run={n + 1}") if d.startswith("bucket=")}
            ids = [i["id"] for i in files[k]["results"]]
            touched = spark.createDataFrame([(i,) for i in ids], "id string").select(buckets.bucket_of(F.col("id"), 16)).distinct().collect()
            assert written == {f"bucket={r[0]}" for r in touched}
        found.append(sorted(map(str, streams.read_upserted(spark, table, "S").collect())))
        first = buckets.read_state(spark, table, "S", streams.PAGE_INDEX, buckets.read_manifest(spark, table, "S", 1))
        assert {r["id"] for r in first.collect()} == {i["id"] for i in files[order[0]]["results"]}  # an old manifest stays readable
    assert found[0] == found[1] and len(found[0]) == len({i["id"] for f in files for i in f["results"]})


def test_empty_state(spark, tmp_path):
    table = str(tmp_path / "t")
    assert buckets.read_manifest(spark, table, "S") is None and streams.read_upserted(spark, table, "S").count() == 0
    streams.upsert_batch(spark.createDataFrame([], streams.PAGE_INDEX), 0, table, "S", NOW)
    assert buckets.read_manifest(spark, table, "S").run == 1 and streams.read_upserted(spark, table, "S").count() == 0


def random_body(rng, pages):
    pieces = [f"<p>text {rng.randrange(100)}</p>", "<ul><li>one</li><li>two</li></ul>" * rng.randint(0, 1)]
    makers = [lambda: include(rng.choice(pages)), lambda: children(rng.choice(pages)), children, lambda: link(rng.choice(pages))]
    pieces += [rng.choice(makers)() for _ in range(rng.randint(0, 3))]
    return "".join(pieces)


def test_upkeep_equals_full_conversion(spark, tmp_path, no_users):
    """After random changes of bodies, titles, parents, and pages that come and go."""
    rng = random.Random(12)
    state = {n: {"version": 1, "parent": rng.choice([None, *range(1, n)]), "body": random_body(rng, range(1, 13)), "name": n} for n in range(1, 11)}
    options = SyncOptions("S", "", str(tmp_path / "kept"), NOW, markdown=MarkdownOptions(resolved_links=True))

    def landed(step):
        items = [page(n, version=s["version"], parent=s["parent"], body=s["body"], when=f"2025-10-{s['version']:02}T10:00:00Z") for n, s in state.items()]
        for item, s in zip(items, state.values(), strict=True):
            item["title"] = f"Page {s['name']}"
        return land(tmp_path / f"in{step}", "a.json", envelope(0, items, limit=len(items) + 1))

    for step in range(3):
        o = replace(options, landing=landed(step), now=datetime(2025, 11, 2 + step))
        made = sync_corpus(spark, o, no_users).count()
        assert made == len(state) if step == 0 else made < len(state)
        index = sinks.read_latest(spark, f"{o.tables}/page_index", "S")
        pages = current_table(spark, o, "html").select("id", "html").join(index.select("id", "title"), "id")
        whole = {r["id"]: r["markdown"] for r in refs.pages_to_markdown(pages, index, no_users, o.markdown).collect()}
        assert {r["id"]: r["markdown"] for r in current_table(spark, o, "markdown").collect()} == whole and len(whole) == len(state), step
        changed = rng.sample(sorted(state), 2)
        for n in changed:
            state[n]["version"] += 1
            state[n]["body"] = random_body(rng, range(1, 13))
        if step == 0:  # a title that pages name, but none had; a page that moves
            state[changed[0]]["name"] = 12
            state[changed[1]]["parent"] = rng.choice([n for n in sorted(state) if n != changed[1]])
        else:
            del state[rng.choice(sorted(state))]
            state[11] = {"version": 1, "parent": rng.choice(sorted(state)), "body": random_body(rng, range(1, 13)), "name": 11}


def test_includes_from_earlier_batches(spark, tmp_path, no_users):
    """A stream's page includes one that landed before, and is converted again when that one changes."""
    index = spark.createDataFrame([(0, "1", "Page 1", None), (1, "2", "Page 2", "1")], "pos long, id string, title string, parent_id string")
    out, progress = str(tmp_path / "md"), str(tmp_path / "p")

    def run(name, *items):
        landing = land(tmp_path / "in", name, envelope(0, list(items), limit=len(items)))
        streams.stream_transform(spark, landing, progress, out, "S", index, no_users).awaitTermination()
        return {r["id"]: r["markdown"].rsplit("---\n\n", 1)[1] for r in streams.read_transformed(spark, out).collect()}

    assert "one" in run("a.json", page(2, body="<ul><li>one</li></ul>"))["2"]
    first = run("b.json", page(1, body="<p>top</p>" + include(2)))
    assert "## Page 2" in first["1"] and "- one" in first["1"] and "top" in first["1"]
    second = run("c.json", page(2, version=2, when="2025-10-02T10:00:00Z", body="<ul><li>two</li></ul>" + children(1)))
    assert "- two" in second["1"] and "- one" not in second["1"] and "two" in second["2"]
    assert run("d.json", page(2, version=1, body="<p>stale</p>")) == second
    assert spark.read.parquet(f"{out}/batch=3").count() == 0


def test_stored_transform_takes_includes_and_dependents(spark, tmp_path, no_users):
    options = SyncOptions("S", "", str(tmp_path / "tables"), NOW)
    pages = [page(1, body="<p>top</p>" + include(2)), page(2, body="<ul><li>one</li></ul>")]
    sync_corpus(spark, replace(options, landing=land(tmp_path / "in", "a.json", envelope(0, pages, limit=3))), no_users)
    again = transform_stored(spark, replace(options, force=True, page_id="1", subtree=False), no_users).collect()
    assert [r["id"] for r in again] == ["1"] and "## Page 2" in again[0]["markdown"] and "- one" in again[0]["markdown"]
    assert transform_stored(spark, options, no_users).count() == 0
