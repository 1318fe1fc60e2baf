"""Readers, writers, streams and the sync job over small landed files."""

import json
import os
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wikitables.operators.refs import MarkdownOptions
from wikitables.plans import storage
from wikitables.sources import buckets, files, readers, sinks
from wikitables.streaming import streams
from wikitables.sync import SyncOptions, current_table, migrate_sidecars, sync_corpus, transform_stored

NOW = datetime(2025, 11, 1)


def page(n, version=1, when="2025-10-01T10:00:00.000Z", parent=None, body="<p>b</p>", history=None):
    item = {"id": str(n), "title": f"Page {n}", "version": {"number": version, "when": when}, "body": {"storage": {"value": body}}}
    if parent:
        item["ancestors"] = [{"id": "root"}, {"id": str(parent)}]
    if history:
        item["history"] = {"lastUpdated": {"when": history}}
    return item


def envelope(start, items, limit=2, more=True, space="S"):
    links = {"next": "/more"} if more else {}
    return {"space": space, "results": items, "start": start, "limit": limit, "size": len(items), "_links": links}


def land(folder, name, *envelopes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in envelopes))
    return str(folder)


def test_listing(spark, tmp_path):
    path = land(
        tmp_path / "in", "a.json",
        envelope(0, [page(1), page(2, when="", history="2025-10-02T12:00:00+02:00", parent=1)]),
        envelope(2, [page(3, body=None)]),
        envelope(4, [page(9)]),
    )
    rows = readers.scan_page_envelopes(spark, path).orderBy("pos").collect()
    assert [(r["id"], r["pos"], r["api_page_number"], r["parent_id"], r["body"]) for r in rows] == [
        ("1", 0, 1, None, "<p>b</p>"), ("2", 1, 1, "1", "<p>b</p>"), ("3", 2, 2, None, ""),
    ]
    assert rows[1]["modified_at"] == datetime(2025, 10, 2, 10)
    meta = readers.scan_page_metadata(spark, path)
    assert "body" not in meta.columns and meta.count() == 3
    assert "storage" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_trees(spark, tmp_path):
    root = str(tmp_path / "out")
    files = spark.createDataFrame(
        [("S/1-home.html", "<p>é</p>"), ("S/images/2-x.html", "no"), ("S/_3-x.html", "no"), ("_q/4-x.html", "no"), ("S/a b%20+/5-y.html", "z"),
         ("S/1-home.md", "m"), ("links/1-home.md", "no"), ("S/1.meta.json", '{\n"pageId":"1","version":2,"downloadedAt":"2025-10-01T00:00:00Z"}')],
        "path string, content string",
    )
    assert sinks.write_files(files, root).agg(F.count("*")).first()[0] == 8
    got = {r["path"]: (r["id"], r["html"]) for r in readers.scan_html_tree(spark, root).collect()}
    assert got == {"S/1-home.html": ("1", "<p>é</p>"), "S/a b%20+/5-y.html": ("5", "z")}
    assert [r["path"] for r in readers.scan_markdown_tree(spark, root).collect()] == ["S/1-home.md"]
    assert [(r["page_id"], r["version"]) for r in readers.scan_meta_sidecars(spark, root).collect()] == [("1", 2)]


def test_users_and_attachments(spark, tmp_path):
    cache = {"ann": {"userKey": "k", "username": "ann", "displayName": "Ann"}, "key:k": {"userKey": "k", "username": "ann", "displayName": "Ann"}}
    (tmp_path / "cache.json").write_text(json.dumps(cache, indent=2))
    rows = {(r["key_kind"], r["key"]) for r in readers.scan_user_cache(spark, str(tmp_path / "cache.json")).collect()}
    assert rows == {("username", "ann"), ("userkey", "k")}
    (tmp_path / "files" / "77").mkdir(parents=True)
    (tmp_path / "files" / "77" / "my pic.png").write_bytes(b"\x00\x01")
    row = readers.scan_attachments(spark, str(tmp_path / "files")).first()
    assert (row["page_id"], row["filename"], bytes(row["content"])) == ("77", "my pic.png", b"\x00\x01")


def test_runs(spark, fx_index, tmp_path):
    table = str(tmp_path / "index")
    assert sinks.read_latest(spark, table, "S") is None
    sinks.write_index(fx_index, table, "S", 1, NOW)
    sinks.write_index(fx_index.where("id <> '100003'"), table, "S", 2, NOW)
    fx_index.limit(1).write.parquet(f"{table}/space=S/run=3")  # a run that did not finish
    assert sinks.read_latest(spark, table, "S").count() == 4
    assert sorted(r["total_rows"] for r in sinks.read_runs(spark, table, "S").collect()) == [4, 5]


def test_checkpoint_folder_must_be_shared(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.checkpoint_folder(Session())


def test_streams(spark, tmp_path, no_users):
    landing = land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2)]))
    table, progress = str(tmp_path / "index"), str(tmp_path / "progress")

    def upsert():
        streams.stream_index_upsert(spark, landing, progress, table, "S", NOW).awaitTermination()
        return {r["id"]: r["version"] for r in streams.read_upserted(spark, table, "S").collect()}

    assert upsert() == {"1": 1, "2": 1}
    land(tmp_path / "in", "b.json", envelope(0, [page(2, version=3), page(3)]))
    assert upsert() == {"1": 1, "2": 3, "3": 1}
    before = buckets.read_manifest(spark, table, "S")
    streams.upsert_batch(readers.scan_page_metadata(spark, landing), 0, table, "S", NOW)
    assert buckets.read_manifest(spark, table, "S") == before

    raw = str(tmp_path / "raw")
    for _ in range(2):
        streams.stream_index_ingest(spark, landing, str(tmp_path / "p2"), raw, "S", NOW).awaitTermination()
    assert spark.read.parquet(raw).count() == 4

    index = readers.scan_page_metadata(spark, landing).select("pos", "id", "title", "parent_id").dropDuplicates(["id"])
    out = str(tmp_path / "md")
    streams.stream_transform(spark, landing, str(tmp_path / "p3"), out, "S", index, no_users, files_per_batch=1).awaitTermination()
    assert sorted(r["id"] for r in streams.read_transformed(spark, out).collect()) == ["1", "2", "3"]  # page 2 twice: its newer version counts


def test_sync_twice(spark, tmp_path, no_users):
    landing = land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2, parent=1)]), envelope(2, [page(3)], more=False))
    tables = str(tmp_path / "tables")

    def sync(now=NOW):
        options = SyncOptions("S", landing, tables, now, markdown=MarkdownOptions(base_url="http://w"))
        return {r["id"]: r["markdown"] for r in sync_corpus(spark, options, no_users).collect()}

    first = sync()
    assert sorted(first) == ["1", "2", "3"] and first["1"].endswith("---\n\nb\n")
    assert sync() == {}
    index = sinks.read_latest(spark, f"{tables}/page_index", "S")
    assert {r["id"]: r["downloaded_version"] for r in index.collect()} == {"1": 1, "2": 1, "3": 1}
    land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2, version=2, parent=1, body="<b>new</b>")], more=False))
    assert list(sync(datetime(2025, 12, 1))) == ["2"]
    assert sorted(r["id"] for r in sinks.read_latest(spark, f"{tables}/page_index", "S").collect()) == ["1", "2"]
    html = sinks.read_latest(spark, f"{tables}/html", "S").first()
    assert html["path"] == "out/S/1-page-1/2-page-2.html"
    links = [r["line"] for r in sinks.read_latest(spark, f"{tables}/site_tree", "S").orderBy("ordinal").collect()]
    assert links == ["# Documentation Links", "- **1-page-1/**", "  - [2-page-2.md](1-page-1/2-page-2.md)", "- [1-page-1.md](1-page-1.md)"]


def test_sync_subtree_images_and_incremental(spark, tmp_path, no_users):
    image = '<ac:image><ri:attachment ri:filename="A b.png" /></ac:image>'
    landing = land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2, parent=1, body=image)]), envelope(2, [page(3)], more=False))
    tables = str(tmp_path / "tables")
    files = spark.createDataFrame([("2", "A b.png", b"x")], "page_id string, filename string, content binary")

    def sync(**options):
        return sorted(r["id"] for r in sync_corpus(spark, SyncOptions("S", landing, tables, **options), no_users, files).collect())

    with pytest.raises(ValueError, match="not in the tree"):
        sync(now=NOW, page_id="77")
    assert sync(now=NOW, page_id="1") == ["1", "2"]
    images = sinks.read_latest(spark, f"{tables}/images", "S").collect()
    assert [(r["path"], bytes(r["content"])) for r in images] == [("out/S/1-page-1/images/a-b.png", b"x")]
    land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2, version=5, when="2025-11-02T00:00:00Z", parent=1)], more=False))
    assert sync(now=datetime(2025, 12, 1), mode="incremental") == ["2"]  # page 3 is queued, but its body is gone
    assert sinks.read_latest(spark, f"{tables}/page_index", "S").count() == 3


def test_current_tables_and_stored_transforms(spark, tmp_path, no_users):
    """Runs of changes read as one corpus; limited conversions go on; one page alone; deleted pages are gone."""
    landing = land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2, parent=1)]), envelope(2, [page(3)], more=False))
    options = SyncOptions("S", landing, str(tmp_path / "tables"), NOW)
    bodies = lambda: {r["id"]: r["markdown"].rsplit("---\n\n", 1)[1] for r in current_table(spark, options, "markdown").collect()}
    folder = storage.checkpoint_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    sync_corpus(spark, options, no_users)
    assert set(os.listdir(folder)) <= before  # intermediate tables are gone
    assert transform_stored(spark, options, no_users).count() == 0
    again = transform_stored(spark, replace(options, force=True, page_id="1", limit=1), no_users)
    assert [r["id"] for r in again.collect()] == ["1"]
    assert bodies() == {"1": "b\n", "2": "b\n", "3": "b\n"}
    land(tmp_path / "in", "a.json", envelope(0, [page(1), page(2, version=2, parent=1, body="<b>new</b>")], more=False))
    sync_corpus(spark, replace(options, now=datetime(2025, 12, 1)), no_users)
    assert bodies() == {"1": "b\n", "2": "**new**\n"}
    assert {r["id"] for r in current_table(spark, options, "html").collect()} == {"1", "2"}


def test_newest_version_wins_and_spaces_stay_apart(spark, tmp_path, no_users):
    landing = land(
        tmp_path / "in", "a.json",
        envelope(0, [page(7, version=9, body="<p>nine</p>"), page(1)], limit=300),
        envelope(250, [page(7, version=5, body="<p>five</p>")], limit=300), envelope(0, [page(99)], space="T", more=False),
    )
    table, progress = str(tmp_path / "index"), str(tmp_path / "progress")
    streams.stream_index_upsert(spark, landing, progress, table, "S", NOW).awaitTermination()
    assert {r["id"]: r["version"] for r in streams.read_upserted(spark, table, "S").collect()} == {"1": 1, "7": 9}
    land(tmp_path / "in", "b.json", envelope(0, [page(7, version=3, when="2030-01-01T00:00:00Z"), page(1, version=2)], limit=2))
    streams.stream_index_upsert(spark, landing, progress, table, "S", NOW).awaitTermination()
    assert {r["id"]: r["version"] for r in streams.read_upserted(spark, table, "S").collect()} == {"1": 2, "7": 9}
    raw = str(tmp_path / "raw")
    streams.stream_index_ingest(spark, landing, str(tmp_path / "p2"), raw, "T", NOW).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(raw).collect()] == ["99"]
    index = spark.createDataFrame([(0, "7", "Page 7", None)], "pos long, id string, title string, parent_id string")
    out = str(tmp_path / "md")
    for k, force in enumerate((False, True)):
        streams.stream_transform(spark, landing, str(tmp_path / f"p3{k}"), out, "S", index, no_users, force=force).awaitTermination()
        got = {r["id"]: r["markdown"].rsplit("---\n\n", 1)[1] for r in streams.read_transformed(spark, out).collect()}
        assert got == {"1": "b\n", "7": "nine\n"}


def test_edited_page_is_converted_again_by_force(spark, tmp_path, no_users):
    index = spark.createDataFrame([(0, "1", "Page 1", None)], "pos long, id string, title string, parent_id string")
    out, progress = str(tmp_path / "md"), str(tmp_path / "p")
    for name, version, body in (("a.json", 1, "<p>old</p>"), ("b.json", 2, "<p>new</p>")):
        landing = land(tmp_path / "in", name, envelope(0, [page(1, version=version, body=body)], limit=1))
        streams.stream_transform(spark, landing, progress, out, "S", index, no_users, force=True).awaitTermination()
    assert [r["markdown"].rsplit("---\n\n", 1)[1] for r in streams.read_transformed(spark, out).collect()] == ["new\n"]


def test_repeated_folder_names(spark, tmp_path):
    root = str(tmp_path / "out")
    files = spark.createDataFrame([("1-a.html", "x"), ("SP/out/1-a.html", "y"), ("out/2-b.html", "z")], "path string, content string")
    assert sinks.write_files(files, root).count() == 3
    for spelled in (root, f"file://{root}/"):
        assert {r["path"]: r["html"] for r in readers.scan_html_tree(spark, spelled).collect()} == {"1-a.html": "x", "SP/out/1-a.html": "y", "out/2-b.html": "z"}


def test_timestamps_in_the_hour_that_comes_twice(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("2025-11-02T05:30:00Z",), ("2025-11-02T06:30:00.5Z",), ("2025-03-09T03:30:00-04:00",), (None,)], "t string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(readers.timestamp(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [datetime(2025, 11, 2, 5, 30), datetime(2025, 11, 2, 6, 30, 0, 500_000), datetime(2025, 3, 9, 7, 30), None]


def test_files_need_a_shared_root_on_a_cluster(spark):
    class Frame:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                master = "yarn"

    with pytest.raises(ValueError, match="shared file system"):
        sinks.write_files(Frame(), "/tmp/out")


def test_files_below_the_shared_folders_of_a_cluster(spark, tmp_path):
    """A cluster's checkpoint folder may be named without a scheme, or as Hadoop spells it."""

    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == storage.CHECKPOINT_SETTING else default

    class Session:
        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,3000]"

        conf, _jvm, _jsparkSession = Conf(), spark._jvm, spark._jsparkSession

    class Frame:
        sparkSession = Session()

        def select(self, *columns):
            return spark.createDataFrame([("a/1-é %20+.html", "x")], "path string, content string").select(*columns)

    for k, root in enumerate((f"{tmp_path}/plain k", f"file:{tmp_path}/one", f"file://{tmp_path}/three")):
        assert sinks.write_files(Frame(), root).count() == 1, k
        got = readers.scan_html_tree(spark, root).collect()
        assert [(r["path"], r["html"]) for r in got] == [("a/1-é %20+.html", "x")]
    with pytest.raises(ValueError, match="shared file system"):
        sinks.write_files(Frame(), f"{tmp_path}-other")


def test_cutoff_leaves_responses_in_their_tasks(spark, tmp_path):
    """Responses of one space stay in the tasks that read them, not all in one."""
    landing = tmp_path / "in"
    for k in range(6):
        land(landing, f"{k}.json", envelope(k, [page(k)], limit=1))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "1", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        rows = readers.scan_page_envelopes(spark, str(landing)).select("id", F.spark_partition_id().alias("task")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(r["id"] for r in rows) == [str(k) for k in range(6)]
    assert len({r["task"] for r in rows}) == 6


def test_trees_and_images_below_the_shared_folder_of_a_cluster(spark, tmp_path, monkeypatch):
    """Each reader gets back what was written below a checkpoint folder that is named without a scheme."""
    monkeypatch.setattr(storage, "CHECKPOINT_SETTING", "wikitables.test.checkpoint")
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    spark.conf.set("wikitables.test.checkpoint", str(tmp_path))
    pages = spark.createDataFrame([("1", "<p>é</p>")], "id string, html string")
    paths = spark.createDataFrame([("1", "out/1-a.html", "out/1")], "id string, path string, dir string")
    state = json.dumps({"pageId": "1", "version": 2, "modifiedDate": "2025-10-01T10:00:00Z", "downloadedAt": "2025-10-01T10:00:00Z"})
    files = spark.createDataFrame([("1/a b.png", "x"), ("out/2-b.md", "y"), ("out/3.meta.json", state)], "path string, content string")
    images = spark.createDataFrame([("1", 0, True, "pic.png", b"z")], "page_id string, pos int, found boolean, slug_name string, content binary")
    try:
        assert [r["path"] for r in sinks.write_html(pages, paths, f"{tmp_path}/html").collect()] == ["out/1-a.html"]
        assert [tuple(r) for r in sinks.write_images(images, paths, f"{tmp_path}/images").collect()] == [("out/1/images/pic.png", 1)]
        assert sinks.write_files(files, f"{tmp_path}/files").count() == 3
    finally:
        spark.conf.unset("wikitables.test.checkpoint")
    assert [tuple(r) for r in readers.scan_html_tree(spark, f"{tmp_path}/html").collect()] == [("out/1-a.html", "1", "<p>é</p>")]
    assert [r["path"] for r in readers.scan_markdown_tree(spark, f"{tmp_path}/files").collect()] == ["out/2-b.md"]
    assert ("1", "a b.png", b"x") in [tuple(r) for r in readers.scan_attachments(spark, f"{tmp_path}/files").collect()]
    assert [(r["path"], r["page_id"], r["version"]) for r in readers.scan_meta_sidecars(spark, f"{tmp_path}/files").collect()] == [("out/3.meta.json", "1", 2)]
    assert (tmp_path / "images/out/1/images/pic.png").read_bytes() == b"z"


def test_sidecars_are_listed_by_tasks(spark, fx_index, tmp_path, monkeypatch):
    """No sidecar is named to the driver; folders are passed on from round to round until all are listed."""
    root, options = tmp_path / "files", SyncOptions("S", "", str(tmp_path / "tables"), NOW)
    for k in range(40):
        folder = root / f"a{k % 5}" / f"b{k % 10}" / "c"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k:02}.meta.json").write_text(json.dumps({"pageId": str(100001 + k % 8), "version": k, "downloadedAt": "2025-10-01T10:00:00Z"}))
    sinks.write_index(fx_index, f"{options.tables}/page_index", "S", 1, NOW)
    for name, value in (("FIRST_ROUND", 2), ("KEPT_FOLDERS", 1), ("BATCH_ROWS", 3)):
        monkeypatch.setattr(files, name, value)
    scanned = readers.scan_meta_sidecars(spark, str(root))
    assert not [name for name in scanned.inputFiles() if name.endswith(".meta.json")]
    assert sorted(r["version"] for r in scanned.collect()) == list(range(40))
    skipped = migrate_sidecars(spark, options, str(root))
    assert {r["page_id"] for r in skipped.collect()} == {"100006", "100007", "100008"}
    now = {r["id"]: r["downloaded_version"] for r in sinks.read_latest(spark, f"{options.tables}/page_index", "S").collect()}
    last = {str(100001 + k % 8): k for k in sorted(range(40), key=lambda k: (k % 5, k % 10, k))}
    assert now == {page: last[page] for page in now} and len(now) == 5


def test_sidecars_of_any_form(spark, tmp_path):
    """Lists, encodings and broken files as Spark's JSON reader takes them; the tasks' number follows what there is to read."""
    ok = '{"pageId":"1","version":2,"downloadedAt":"2025-10-01T10:00:00Z"}'
    forms = {
        "a": ok, "b": f"\n[{ok}, {ok}]", "c": "{bad", "d": "", "e": " \n", "f": "[]", "g": '{"pageId":5,"version":"x"}', "h": "\ufeff" + ok, "i": ok.encode("utf-16"),
        "j": ok.encode()[:-1] + b',"x":"\xff"}', "k": ok + " trailing", "l": "null", "m": "[1, 2]", "n": '[{"pageId":"1","version":"x"}, {"pageId":"2","version":3}]', "o": f"[{ok}, {{bad]",
    }
    for name, data in forms.items():
        (tmp_path / f"{name}.meta.json").write_bytes(data if isinstance(data, bytes) else data.encode())
    rows = readers.scan_meta_sidecars(spark, str(tmp_path))
    got = sorted((r["path"][0], r["page_id"], r["version"]) for r in rows.fillna({"page_id": "", "version": 0}).collect())
    whole, nothing = ("1", 2), ("", 0)
    assert got == sorted([(n, *whole) for n in "abbhik"] + [(n, *nothing) for n in "cjlmo"] + [("g", "5", 0), ("n", "1", 0), ("n", "2", 3)])
    assert not [name for name in rows.inputFiles() if name.endswith(".meta.json")]
    assert rows.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_written_files_are_read_back_by_tasks(spark, tmp_path, monkeypatch):
    """The checks of write_html, write_markdown and write_images see every file that was written, empty ones too, without naming any to the driver."""
    from checks import queries
    from checks.views import Views

    monkeypatch.setattr(queries, "_scratch", lambda v, name: f"{tmp_path}/{name}")
    written = spark.range(60).selectExpr("concat('out/a', id % 7, '/', id, '.html') AS path", "repeat('é', cast(id AS int)) AS content")
    got = queries._read_back(Views(spark, "/root/testdata/sf0.001"), lambda root: sinks.write_files(written, root))
    assert not [name for name in got.inputFiles() if name.endswith(".html")]
    wanted = written.selectExpr("path", "cast(octet_length(content) AS bigint) AS bytes", "md5(encode(content, 'utf-8')) AS content")
    assert got.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_markdown_files_are_read_back_by_tasks(spark, tmp_path, monkeypatch):
    """What write_markdown has written is seen whole and without naming a file to the driver, in few tasks."""
    from checks import queries
    from checks.views import Views

    monkeypatch.setattr(queries, "_scratch", lambda v, name: f"{tmp_path}/{name}")
    pages = spark.range(90).selectExpr("cast(id AS string) AS id", "concat(id, '-page.md') AS file", "concat('# ', id, repeat(' ü', cast(id AS int)), '\n') AS markdown")
    paths = spark.range(90).selectExpr("cast(id AS string) AS id", "concat('out/DOCS/', id % 4, '-top') AS dir")
    got = queries._read_back(Views(spark, "/root/testdata/sf0.001"), lambda root: sinks.write_markdown(pages, paths, root))
    assert not [name for name in got.inputFiles() if name.endswith(".md")]
    assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = pages.join(paths, "id").selectExpr("concat(dir, '/', file) AS path", "cast(octet_length(markdown) AS bigint) AS bytes", "md5(encode(markdown, 'utf-8')) AS content")
    assert sorted(got.collect()) == sorted(wanted.collect()) and got.count() == 90
