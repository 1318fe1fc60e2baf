"""One entry per operator: the Spark query over the given tables, and the DuckDB statement it must equal."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikitables.functions import rules as R
from wikitables.functions import text as T
from wikitables.functions.regex import extract_all
from wikitables.operators import index_ops as ix
from wikitables.operators import markdown as M
from wikitables.operators import digests, intervals, refs, tree
from wikitables.plans.storage import checkpoint_folder, store
from wikitables.schemas import INDEX_COLUMNS, META_COLUMNS
from wikitables.sources import changes, files, readers, sinks
from wikitables.streaming import streams
from wikitables.sync import SyncOptions, current_table, maintain, migrate_sidecars, sync_corpus, transform_stored

from . import duck as D
from .views import QueryFn, Views, duck_with

NOW = datetime(2024, 2, 1)
_NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
SPACE, ROOT = "DOCS", "out/DOCS"
PAGE_SIZE = 25
# Responses in a file of the landed listing; small listings lie in four files.
FILE_RESPONSES = 400

QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def add(key: str, sql: str | None, *views: str):
    """Register a query; ``sql`` is the statement after the ``WITH`` clauses of the named views."""

    def register(fn: QueryFn) -> QueryFn:
        full = None if sql is None else (f"{duck_with(*views)} {sql}" if views else sql)
        QUERIES[key] = (fn, full)
        return fn

    return register


def cte(sql: str) -> str:
    """Continue the ``WITH`` clauses of the views with more clauses."""
    return ", " + sql


def _id_pages(v: Views) -> DataFrame:
    return v.pages.select(F.col("page_id").cast("string").alias("id"), "html")


# ---- conversion of raw pages -----------------------------------------------------------


def _tasks(v: Views) -> int:
    """Partitions for work on bodies, as the session is set: the tables of pages are single files."""
    return int(v.pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))


add("markdown_pages", f"SELECT CAST(page_id AS VARCHAR) AS id, {D.convert_plain(D.newlines('html'))} AS markdown FROM pages")(
    lambda v: M.markdown_pages(_id_pages(v), _tasks(v))
)

# ---- text functions ----------------------------------------------------------------------


def _text_key(key: str, column: str, spark_fn, duck_expr: str, view: str = "v_pages") -> None:
    add(key, f"SELECT id, {duck_expr} AS {column} FROM {view}", view)(
        lambda v: getattr(v, view).select("id", spark_fn().alias(column))
    )


_text_key("slugify", "slug", lambda: T.slugify(F.col("title")), D.slug("title"))
_text_key("slugify50", "slug", lambda: T.slugify50(F.col("title")), D.slug50("title"))
_text_key("unslugify", "words", lambda: T.unslugify(F.concat(F.col("id"), F.lit("-"), T.slugify(F.col("title")))), D.unslug(f"(id || '-' || {D.slug('title')})"))
_text_key("split_extension", "parts", lambda: F.concat_ws("|", T.split_extension(F.col("url"))["base"], T.split_extension(F.col("url"))["ext"]), f"({D.base_of('url')} || '|' || {D.ext_of('url')})")
_text_key("page_filename", "filename", lambda: T.page_filename(F.col("id"), F.col("title")), f"(id || '-' || {D.slug('title')} || '.md')")
_text_key("page_url", "address", lambda: T.page_url("http://wiki/", F.col("id")), "('http://wiki/pages/viewpage.action?pageId=' || id)")
_text_key("file_id", "prefix", lambda: T.file_id(F.col("url")), "string_split(url, '-')[1]")
_text_key("url_basename", "name", lambda: T.url_basename(F.col("url")), D.url_basename("url"))
_text_key("encode_uri", "encoded", lambda: T.encode_uri(F.concat_ws("~", "title", "url")), D.encode_uri("concat_ws('~', title, url)"))
_text_key("decode_uri", "decoded", lambda: T.decode_uri(T.encode_uri(F.concat_ws("+", "title", "url"))), D.decode_uri(D.encode_uri("concat_ws('+', title, url)")))
_text_key("simple_name", "simple", lambda: T.simple_name(F.concat(F.lit("-_ "), F.col("title"))), D.simple_name("('-_ ' || title)"))
_text_key("text_decode", "decoded", lambda: T.text_decode(F.col("html")), D.text_decode("html"))
_text_key("yaml_quote", "quoted", lambda: T.yaml_quote(F.col("html")), "replace(html, '\"', '\\\"')")
_text_key("trim_ws", "trimmed", lambda: T.trim_ws(F.concat(F.lit(" \n\t "), F.col("title"), F.lit("　 \n"))), D.trim("(' ' || chr(10) || chr(9) || chr(160) || title || chr(12288) || ' ' || chr(10))"))
_text_key("child_link", "link", lambda: T.child_link(F.col("title")), D.child_link("title"))
_text_key("front_matter", "front", lambda: T.front_matter(F.col("title"), F.col("id"), T.page_url("http://wiki", F.col("id"))), D.front_matter("title", "id", "('http://wiki/pages/viewpage.action?pageId=' || id)"))
add("container_id", f"SELECT id, coalesce(nullif({D.extract('html', R.CONTAINER_ID, 1, 'i')}, ''), id) AS container FROM v_storage", "v_storage")(
    lambda v: v.v_storage.select("id", T.container_id(F.col("html"), F.col("id")).alias("container"))
)
add("iso_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")(
    lambda v: v.events.select("event_id", T.iso_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))
)
add("relative_path", "SELECT path, substring(path, 5) AS relative FROM v_html_files", "v_html_files")(
    lambda v: v.v_html_files.select("path", T.relative_path(F.col("path"), "out").alias("relative"))
)
add("depth", "SELECT path, CAST(len(string_split(path, '/')) - 2 AS INT) AS depth FROM v_html_files", "v_html_files")(
    lambda v: v.v_html_files.select("path", T.depth(F.col("path"), "out").alias("depth"))
)
add(
    "page_status",
    """SELECT id, CASE WHEN downloaded_at IS NULL THEN true WHEN coalesce(version,0) > coalesce(downloaded_version,0) THEN true
 WHEN coalesce(downloaded_version,0)=0 AND modified_at > downloaded_at THEN true ELSE false END AS needs_download,
 CASE WHEN downloaded_at IS NULL THEN 'new' WHEN coalesce(version,0) > coalesce(downloaded_version,0) THEN 'updated'
 WHEN coalesce(downloaded_version,0)=0 AND modified_at > downloaded_at THEN 'updated' ELSE 'up-to-date' END AS reason,
 CASE WHEN downloaded_at IS NULL THEN NULL WHEN coalesce(version,0) > coalesce(downloaded_version,0)
 THEN 'v' || coalesce(downloaded_version,0) || ' → v' || coalesce(version,0)
 WHEN coalesce(downloaded_version,0)=0 AND modified_at > downloaded_at THEN 'modified after download' END AS details FROM v_index""",
    "v_index",
)(
    lambda v: v.v_index.select(
        "id", T.page_status(F.col("version"), F.col("downloaded_version"), F.col("downloaded_at"), F.col("modified_at")).alias("s")
    ).select("id", "s.*")
)

# ---- index: projections, filters, diff --------------------------------------------------------

_META = ", ".join(META_COLUMNS)
_INDEX = ", ".join(INDEX_COLUMNS)

add("page_metadata", f"SELECT {_META} FROM v_index", "v_index")(lambda v: ix.page_metadata(v.v_index))
add("limit_pages", f"SELECT {_META} FROM v_current ORDER BY pos LIMIT 100", "v_current")(lambda v: ix.limit_pages(v.v_current, 100))
add("pages_by_id", "SELECT id, title FROM v_pages WHERE id IN (SELECT id FROM v_index)", "v_pages", "v_index")(
    lambda v: ix.pages_by_id(v.v_pages, v.v_index).select("id", "title")
)
add("missing_ids", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT id FROM v_index)", "v_index")(
    lambda v: ix.missing_ids(v.v_index, v.events.select(F.col("user_id").cast("string").alias("id")))
)
add("scan_page_body", "SELECT p.id, p.title, coalesce(p.html, '') AS body FROM v_pages p WHERE p.id IN (SELECT id FROM v_current)", "v_pages", "v_current")(
    lambda v: ix.page_bodies(v.v_pages.select("id", "title", F.col("html").alias("body")), v.v_current)
)
add("modified_since", f"SELECT {_META} FROM v_current WHERE modified_at >= date_trunc('day', (SELECT min(indexed_at) FROM v_index))", "v_current", "v_index")(
    lambda v: ix.modified_since(v.v_current, v.v_index.select(F.min("indexed_at")).scalar())
)
add("scan_search_results", f"SELECT {_META} FROM v_current WHERE modified_at >= TIMESTAMP '2024-01-16 00:00:00' ORDER BY modified_at DESC, id", "v_current")(
    lambda v: ix.search_results(v.v_current, v.v_index.select(F.min("indexed_at")).scalar())
)
add("point_lookup", f"SELECT {_INDEX} FROM v_index WHERE id = '7' ORDER BY pos LIMIT 1", "v_index")(lambda v: ix.point_lookup(v.v_index, "7"))
add("order_modified_desc", f"SELECT {_META} FROM v_current ORDER BY modified_at DESC, id", "v_current")(
    lambda v: ix.order_modified_desc(v.v_current)
)
add("oldest_indexed", "SELECT min(indexed_at) AS oldest_indexed FROM v_index", "v_index")(lambda v: ix.oldest_indexed(v.v_index))
add(
    "dedupe_by_id",
    """SELECT min(event_id) AS pos, CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS title, arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
)(
    lambda v: ix.dedupe_by_id(
        v.events.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("title"), "value")
    )
)

_DIFF = """SELECT coalesce(c.id,i.id) AS id, coalesce(c.title,i.title) AS title, i.version AS old_version, c.version AS new_version,
 CASE WHEN i.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'deleted' WHEN nullif(c.version,0) > nullif(i.version,0) THEN 'updated' ELSE 'unchanged' END AS change
 FROM v_current c FULL OUTER JOIN v_index i ON c.id = i.id"""
add("diff_snapshots", _DIFF, "v_current", "v_index")(lambda v: ix.diff_snapshots(v.v_current, v.v_index))


@add("diff_digests", f"SELECT * FROM ({_DIFF}) WHERE change <> 'unchanged'", "v_current", "v_index")
def _diff_digests(v: Views) -> DataFrame:
    """Both states written as snapshots, compared by their digest trees."""
    spark = v.pages.sparkSession
    current, index = _scratch(v, "current"), _scratch(v, "index")
    digests.write_snapshot(v.v_current, current)
    digests.write_snapshot(v.v_index, index)
    return digests.diff_trees(spark, current, index)


add("diff_incremental", f"SELECT * FROM ({_DIFF}) WHERE change <> 'deleted'", "v_current", "v_index")(
    lambda v: ix.diff_snapshots(v.v_current, v.v_index, mode="incremental")
)
add(
    "update_summary",
    f"""SELECT count(*) FILTER (change='new') AS new_pages, count(*) FILTER (change='updated') AS updated_pages,
 count(*) FILTER (change='deleted') AS deleted_pages, count(*) FILTER (change<>'deleted') AS index_size FROM ({_DIFF})""",
    "v_current", "v_index",
)(lambda v: ix.update_summary(ix.diff_snapshots(v.v_current, v.v_index)))
add("added_pages", f"SELECT {_META} FROM v_current WHERE id NOT IN (SELECT id FROM v_index)", "v_current", "v_index")(
    lambda v: ix.added_pages(v.v_current, v.v_index)
)
add("deleted_pages", f"SELECT {_INDEX} FROM v_index WHERE id NOT IN (SELECT id FROM v_current)", "v_current", "v_index")(
    lambda v: ix.deleted_pages(v.v_current, v.v_index)
)
_MODIFIED = "SELECT * FROM v_current WHERE modified_at >= TIMESTAMP '2024-01-16 00:00:00'"


def _modified(v: Views) -> DataFrame:
    return ix.modified_since(v.v_current, F.lit("2024-01-16").cast("timestamp_ntz"))


_OVERLAY = ", ".join(f"CASE WHEN m.id IS NOT NULL THEN m.{c} ELSE i.{c} END AS {c}" for c in META_COLUMNS if c not in ("pos", "id"))
add(
    "upsert_modified",
    f"""SELECT coalesce(i.pos, (SELECT max(pos) FROM v_index) + 1 + m.pos) AS pos, coalesce(i.id, m.id) AS id, {_OVERLAY}
 FROM v_index i FULL OUTER JOIN ({_MODIFIED}) m ON i.id = m.id""",
    "v_current", "v_index",
)(lambda v: ix.upsert_modified(v.v_index, _modified(v)))
add(
    "union_upsert",
    f"""SELECT i.pos, i.id, {', '.join(f'coalesce_{c}' for c in []) }{', '.join(f'CASE WHEN m.id IS NOT NULL THEN m.{c} ELSE i.{c} END AS {c}' for c in META_COLUMNS if c not in ('pos', 'id'))}
 FROM v_index i LEFT JOIN ({_MODIFIED}) m ON i.id = m.id
 UNION ALL SELECT {_META} FROM ({_MODIFIED}) WHERE id NOT IN (SELECT id FROM v_index)""",
    "v_current", "v_index",
)(lambda v: ix.union_upsert(v.v_index, _modified(v)))


def _rebuild_sql(carry: bool) -> str:
    keep = "(i.id IS NOT NULL AND (nullif(i.version,0) IS NULL OR nullif(c.version,0) IS NULL OR i.version = c.version))"
    columns = []
    for c in INDEX_COLUMNS:
        fresh = f"c.{c}" if c in META_COLUMNS else {
            "indexed_at": _NOW_SQL, "page_number": "coalesce(i.page_number, 0)",
        }.get(c, f"i.{c}" if carry else "NULL")
        columns.append("c.pos AS pos" if c == "pos" else f"CASE WHEN {keep} THEN i.{c} ELSE {fresh} END AS {c}")
    return f"SELECT {', '.join(columns)} FROM v_current c LEFT JOIN v_index i ON c.id = i.id"


add("rebuild_index", _rebuild_sql(True), "v_current", "v_index")(lambda v: ix.rebuild_index(v.v_current, v.v_index, NOW))
add("rebuild_index_forgetting", _rebuild_sql(False), "v_current", "v_index")(
    lambda v: ix.rebuild_index(v.v_current, v.v_index, NOW, carry_download_state=False)
)

# ---- queue and download -----------------------------------------------------------------------

_STATUS = """SELECT c.pos, c.id, c.title, c.version, c.parent_id, c.modified_at,
 CASE WHEN nullif(i.downloaded_version,0) IS NULL THEN 'new' WHEN i.downloaded_at IS NULL OR coalesce(i.version,0) > i.downloaded_version THEN 'updated' ELSE 'skip' END AS status
 FROM v_current c LEFT JOIN v_index i ON c.id = i.id"""
add("queue_status", f"SELECT {_META}, status AS queue_reason FROM ({_STATUS}) WHERE status <> 'skip'", "v_current", "v_index")(
    lambda v: ix.queue_status(v.v_current, v.v_index)
)
add("queue_status_forced", f"SELECT {_META}, 'new' AS queue_reason FROM v_current", "v_current")(
    lambda v: ix.queue_status(v.v_current, v.v_index, force=True)
)
add(
    "queue_stats",
    f"""SELECT count(*) FILTER (status='new') AS new_pages, count(*) FILTER (status='updated') AS updated_pages, count(*) FILTER (status='skip') AS skipped_pages,
 least(count(*) FILTER (status<>'skip'), 100) AS queued_pages, count(*) AS tree_pages FROM ({_STATUS})""",
    "v_current", "v_index",
)(lambda v: ix.queue_stats(ix.page_statuses(v.v_current, v.v_index), limit=100))
add("batch_number", "SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 5 + 1 AS batch_no FROM v_tree", "v_tree")(
    lambda v: ix.batch_number(v.v_tree, 5)
)

# paths over the derived page tree (parents come before children by position)
_PATHS = f"""paths(id, dir, child_dir) AS (
 SELECT id, '{ROOT}', '{ROOT}/' || id || '-' || {D.slug50('title')} FROM v_pages WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM v_pages)
 UNION ALL SELECT p.id, t.child_dir, t.child_dir || '/' || p.id || '-' || {D.slug50('p.title')} FROM v_pages p JOIN paths t ON p.parent_id = t.id)"""


def _page_index(v: Views) -> DataFrame:
    return v.v_pages.select("pos", "id", "title", "parent_id")


_PLAN = f"""SELECT q.pos, q.id, coalesce(t.dir, '{ROOT}') AS dir,
 CASE WHEN i.downloaded_version IS NULL OR i.downloaded_at IS NULL THEN 'new' WHEN coalesce(q.version,0) = i.downloaded_version THEN 'skip' ELSE 'update' END AS action,
 i.downloaded_version AS old_version, coalesce(q.version,0) AS new_version
 FROM v_current q LEFT JOIN paths t ON q.id = t.id LEFT JOIN v_index i ON q.id = i.id"""


def _plan(v: Views) -> DataFrame:
    return ix.download_plan(v.v_current, tree.page_paths(tree.with_names(_page_index(v)), ROOT), v.v_index, ROOT)


add("download_plan", cte(f"{_PATHS} {_PLAN}"), "v_pages", "v_current", "v_index")(_plan)
add(
    "batch_stats",
    cte(f"""{_PATHS} SELECT batch_no, count(*) FILTER (action <> 'skip') AS downloaded, count(*) FILTER (action = 'skip') AS skipped
 FROM (SELECT action, (row_number() OVER (ORDER BY pos) - 1) // 5 + 1 AS batch_no FROM ({_PLAN})) GROUP BY batch_no"""),
    "v_pages", "v_current", "v_index",
)(lambda v: ix.batch_stats(_plan(v), 5))
add(
    "merge_download_state",
    f"""SELECT {', '.join(f'i.{c}' for c in INDEX_COLUMNS[:-2])}, CASE WHEN c.id IS NOT NULL THEN coalesce(c.version,0) ELSE i.downloaded_version END AS downloaded_version,
 CASE WHEN c.id IS NOT NULL THEN {_NOW_SQL} ELSE i.downloaded_at END AS downloaded_at FROM v_index i LEFT JOIN v_current c ON i.id = c.id""",
    "v_current", "v_index",
)(lambda v: ix.merge_download_state(v.v_index, v.v_current.select("id", "version"), NOW))
_SIDE = "(SELECT page_id, arg_max(version, path) AS version, arg_max(downloaded_at, path) AS downloaded_at FROM v_sidecars GROUP BY page_id)"
add(
    "merge_sidecars",
    f"""SELECT {', '.join(f'i.{c}' for c in INDEX_COLUMNS[:-2])}, CASE WHEN s.page_id IS NOT NULL THEN s.version ELSE i.downloaded_version END AS downloaded_version,
 CASE WHEN s.page_id IS NOT NULL THEN s.downloaded_at ELSE i.downloaded_at END AS downloaded_at FROM v_index i LEFT JOIN {_SIDE} s ON i.id = s.page_id""",
    "v_index", "v_sidecars",
)(lambda v: ix.merge_sidecars(v.v_index, v.v_sidecars)[0])
add("skipped_sidecars", "SELECT * FROM v_sidecars WHERE page_id NOT IN (SELECT id FROM v_index)", "v_index", "v_sidecars")(
    lambda v: ix.merge_sidecars(v.v_index, v.v_sidecars)[1]
)
add(
    "sidecar_stats",
    "SELECT count(*) FILTER (page_id IN (SELECT id FROM v_index)) AS migrated, count(*) FILTER (page_id NOT IN (SELECT id FROM v_index)) AS skipped FROM v_sidecars",
    "v_index", "v_sidecars",
)(lambda v: ix.sidecar_stats(v.v_index, v.v_sidecars))
_PENDING = "SELECT path FROM {} h WHERE regexp_replace(path, '\\.html$', '') NOT IN (SELECT regexp_replace(path, '\\.md$', '') FROM v_md_files)"
add("pending_transforms", _PENDING.format("v_html_files"), "v_html_files", "v_md_files")(
    lambda v: ix.pending_transforms(v.v_html_files, v.v_md_files)
)
add("files_to_process", _PENDING.format("(SELECT path FROM v_html_files ORDER BY path LIMIT 100)"), "v_html_files", "v_md_files")(
    lambda v: ix.files_to_process(v.v_html_files, v.v_md_files, 100)
)

# ---- hierarchy ------------------------------------------------------------------------------------

_RANKS = """kids AS (SELECT t.*, p.id AS up FROM v_tree t LEFT JOIN v_tree p ON t.parent_id = p.id),
 forest AS (SELECT id, parent_id, title, pos, id AS root_id, 0 AS depth, [pos] AS path, [id] AS ids FROM kids WHERE up IS NULL
 UNION ALL SELECT r.id, r.parent_id, r.title, r.pos, f.root_id, f.depth + 1, list_append(f.path, r.pos), list_append(f.ids, r.id) FROM kids r JOIN forest f ON r.up = f.id)"""


def _path_text(df: DataFrame) -> DataFrame:
    """Arrays as text, which both engines print the same way."""
    return df.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


add("attach_parent", "SELECT c.pos, c.id, c.title, p.id AS parent_id FROM v_pages c LEFT JOIN v_pages p ON c.parent_id = p.id", "v_pages")(
    lambda v: tree.attach_parent(_page_index(v))
)
add("root_pages", "SELECT pos, id, title FROM v_pages WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM v_pages)", "v_pages")(
    lambda v: tree.root_pages(_page_index(v))
)
add("sibling_rank", "SELECT pos, id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY pos, id) AS sibling_rank FROM v_tree", "v_tree")(
    lambda v: tree.sibling_rank(v.v_tree)
)
add("child_pages", "SELECT parent_id, pos, id, title FROM v_tree WHERE parent_id IN (SELECT concat('C', c_custkey) FROM customer)", "v_tree")(
    lambda v: tree.child_pages(v.v_tree, v.customer.select(F.concat(F.lit("C"), F.col("c_custkey")).alias("id")))
)
add("build_forest", cte(f"{_RANKS} SELECT id, parent_id, root_id, depth, depth = 0 AS is_root, array_to_string(path, '.') AS path FROM forest"), "v_tree")(
    lambda v: _path_text(tree.build_forest(v.v_tree)).select("id", "parent_id", "root_id", "depth", "is_root", "path")
)
add(
    "find_subtree",
    cte(f"{_RANKS} SELECT id, depth - 1 AS depth, array_to_string(path[2:], '.') AS path FROM forest WHERE list_contains(ids, 'N3')"),
    "v_tree",
)(lambda v: _path_text(tree.find_subtree(tree.build_forest(v.v_tree), "N3")).select("id", "depth", "path"))
add("preorder", cte(f"{_RANKS} SELECT row_number() OVER (ORDER BY path) AS ordinal, id, parent_id, title FROM forest"), "v_tree")(
    lambda v: tree.preorder(v.v_tree).select("ordinal", "id", "parent_id", "title")
)
add(
    "flatten_preorder",
    cte(f"{_RANKS} SELECT row_number() OVER (ORDER BY path) AS ordinal, id, parent_id, title, {_NOW_SQL} AS indexed_at, 0 AS page_number FROM forest"),
    "v_tree",
)(lambda v: tree.flatten_preorder(tree.build_forest(v.v_tree), NOW).select("ordinal", "id", "parent_id", "title", "indexed_at", "page_number"))
_CHAINS = """chains(id, orphan, ids) AS (
 SELECT id, parent_id IS NOT NULL, [id] FROM v_pages WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM v_pages)
 UNION ALL SELECT p.id, t.orphan, list_append(t.ids, p.id) FROM v_pages p JOIN chains t ON p.parent_id = t.id)"""
add("ancestors", cte(f"{_CHAINS} SELECT id, CASE WHEN orphan THEN '' ELSE array_to_string(ids[:-2], '/') END AS ancestors FROM chains"), "v_pages")(
    lambda v: (lambda i: tree.ancestors(i, tree.build_forest(i), i).withColumn("ancestors", F.array_join("ancestors", "/")))(_page_index(v))
)
add("page_paths", cte(f"{_PATHS} SELECT id, dir, child_dir || '.html' AS path FROM paths"), "v_pages")(
    lambda v: tree.page_paths(tree.with_names(_page_index(v)), ROOT)
)
_LONG = f"""longer(id, orphan, above, path) AS (
 SELECT id, parent_id IS NOT NULL, '{ROOT}/' || id || '-' || {D.slug('title')}, '{ROOT}/' || id || '-' || {D.slug('title')} FROM v_pages WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM v_pages)
 UNION ALL SELECT p.id, t.orphan, t.above || '/' || p.id || '-' || {D.slug('p.title')},
 CASE WHEN t.orphan THEN '{ROOT}' ELSE t.above END || '/' || p.id || '-' || {D.slug('p.title')} FROM v_pages p JOIN longer t ON p.parent_id = t.id)"""
add("page_html_path", cte(f"{_LONG} SELECT id, path || '.html' AS path FROM longer"), "v_pages")(
    lambda v: tree.page_html_path(_page_index(v), _page_index(v), ROOT)
)
add(
    "nested_tree",
    cte(f"""{_RANKS} SELECT row_number() OVER (ORDER BY path) AS ordinal, root_id, id, repeat('    ', depth) || '- id: "' || id || '"' || chr(10) || repeat('    ', depth) || '  title: "' || title || '"' || chr(10)
 || repeat('    ', depth) || CASE WHEN id IN (SELECT up FROM kids WHERE up IS NOT NULL) THEN '  children:' ELSE '  children: []' END AS block FROM forest"""),
    "v_tree",
)(lambda v: tree.nested_tree(tree.build_forest(v.v_tree)))
_SITE = """files AS (SELECT path, string_split(path, '/') AS parts FROM v_md_files),
 folders AS (SELECT DISTINCT parts[1:n] AS folder FROM files, LATERAL (SELECT unnest(range(1, len(parts))) AS n)),
 lines AS (SELECT list_transform(folder, lambda f: '0' || f) AS key, repeat('  ', len(folder) - 1) || '- **' || folder[-1] || '/**' AS line FROM folders
 UNION ALL SELECT list_append(list_transform(parts[:-2], lambda f: '0' || f), '1' || parts[-1]), repeat('  ', len(parts) - 1) || '- [' || parts[-1] || '](' || path || ')' FROM files)"""
add("site_tree", cte(f"{_SITE} SELECT row_number() OVER (ORDER BY key) AS ordinal, line FROM lines"), "v_md_files")(
    lambda v: tree.site_tree(v.v_md_files)
)
add(
    "sorted_site_tree",
    cte(f"{_SITE} SELECT row_number() OVER (ORDER BY key) AS ordinal, line FROM lines UNION ALL SELECT 0, '# Documentation Links'"),
    "v_md_files",
)(lambda v: tree.sorted_site_tree(v.v_md_files))

_CHAIN_FOREST = """steps(id, chain) AS (SELECT id, [id] FROM v_chains WHERE parent_id IS NULL
 UNION ALL SELECT c.id, list_append(s.chain, c.id) FROM v_chains c JOIN steps s ON c.parent_id = s.id)"""


def _chain_index(v: Views) -> DataFrame:
    return v.v_chains.select("pos", "id", "title", "parent_id")


add("deep_forest", cte(f"{_CHAIN_FOREST} SELECT id, CAST(len(chain) - 1 AS INT) AS depth, array_to_string(chain, '/') AS chain FROM steps"), "v_chains")(
    lambda v: tree.build_forest(_chain_index(v)).select("id", "depth", F.array_join("ids", "/").alias("chain"))
)
add("cycle_pages", cte(f"{_CHAIN_FOREST} SELECT pos, id, title, parent_id FROM v_chains WHERE id NOT IN (SELECT id FROM steps)"), "v_chains")(
    lambda v: (lambda i: tree.cycle_pages(i, tree.build_forest(i)))(store(_chain_index(v), "chains"))
)

_LABELS = f"""{_RANKS}, sizes AS (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM forest) GROUP BY id),
 labels AS (SELECT f.id, f.parent_id, f.root_id, f.depth, row_number() OVER (ORDER BY f.path) AS enter, s.n FROM forest f JOIN sizes s ON s.id = f.id)"""
add("interval_forest", cte(f"{_LABELS} SELECT id, parent_id, root_id, depth, enter, enter + n - 1 AS leave FROM labels"), "v_tree")(
    lambda v: intervals.label_intervals(v.v_tree).select("id", "parent_id", "root_id", "depth", "enter", "leave")
)
add("interval_subtree", cte(f"{_LABELS} SELECT id, enter, depth - 1 AS depth FROM labels WHERE id IN (SELECT id FROM forest WHERE list_contains(ids, 'N3'))"), "v_tree")(
    lambda v: intervals.subtree(intervals.write_intervals(intervals.label_intervals(v.v_tree), _scratch(v, "labels")), "N3").select("id", "enter", "depth")
)
add(
    "interval_chains",
    cte(f"{_CHAIN_FOREST} SELECT s.id, CAST(len(chain) - 1 AS INT) AS depth, s.chain[1] AS root_id, (SELECT count(*) FROM steps t WHERE list_contains(t.chain, s.id)) AS below FROM steps s"),
    "v_chains",
)(lambda v: intervals.label_intervals(_chain_index(v)).select("id", "depth", "root_id", (F.col("leave") - F.col("enter") + 1).alias("below")))
add("is_below", cte(f"{_CHAIN_FOREST} SELECT c.id, c.parent_id AS above, s.id IS NOT NULL AS below FROM v_chains c LEFT JOIN steps s ON s.id = c.id WHERE c.parent_id IS NOT NULL"), "v_chains")(
    lambda v: intervals.is_below(intervals.label_intervals(_chain_index(v)), _chain_index(v).where("parent_id is not null").select("id", F.col("parent_id").alias("above")))
)

# ---- references ---------------------------------------------------------------------------------------

_DIMS = f"""lists AS (SELECT parent_id, string_agg({D.child_link('title')}, chr(10) ORDER BY pos) || chr(10) || chr(10) AS list FROM v_pages WHERE parent_id IS NOT NULL GROUP BY parent_id),
 titles AS (SELECT title, arg_min(id, pos) AS id FROM v_pages GROUP BY title),
 includes AS (SELECT t.title, chr(10) || chr(10) || '## ' || t.title || chr(10) || chr(10) || {D.join(D.include_items(D.newlines('s.html')), chr(10))} || chr(10) || chr(10) AS txt FROM titles t JOIN v_storage s ON s.id = t.id),
 dims AS (SELECT (SELECT map(list(username), list(display_name)) FROM v_users) AS by_name, (SELECT map(list(user_key), list(display_name)) FROM v_users) AS by_key,
 (SELECT map(list(t.title), list(coalesce(l.list, {D.lit(R.NO_CHILDREN)}))) FROM titles t LEFT JOIN lists l ON l.parent_id = t.id) AS by_title,
 (SELECT map(list(parent_id), list(list)) FROM lists) AS own, (SELECT map(list(title), list(id)) FROM titles) AS targets,
 (SELECT map(list(title), list(txt)) FROM includes) AS included,
 (SELECT map(list(t.title), list(t.id || '-' || {D.slug50('t.title')} || '.md')) FROM titles t) AS files)"""
_KNOWN = f"CASE WHEN d.targets[{D.macro_title(D.extract('s.html', R.INCLUDE_MACRO, 0, 'i'))}] = s.id THEN MAP {{}} ELSE d.included END"


def _storage(v: Views) -> DataFrame:
    return v.v_storage.select("id", "title", "html")


def _stage_sql(expr: str) -> str:
    return cte(f"{_DIMS} SELECT s.id, {expr} AS html FROM v_storage s, dims d")


add("first_by_title", "SELECT title, arg_min(id, pos) AS id FROM v_pages GROUP BY title", "v_pages")(
    lambda v: refs.first_by_title(_page_index(v))
)
_TITLE_REFS = "(SELECT p.id, q.title FROM v_pages p JOIN v_pages q ON q.pos = p.pos + 7 UNION ALL SELECT id, 'Missing ' || title FROM v_pages)"
add(
    "page_by_title",
    f"SELECT r.id, r.title, t.id AS target_id FROM {_TITLE_REFS} r LEFT JOIN (SELECT title, arg_min(id, pos) AS id FROM v_pages GROUP BY title) t ON r.title = t.title",
    "v_pages",
)(
    lambda v: refs.page_by_title(
        _page_index(v),
        v.v_pages.select("id", (F.col("pos") + 7).alias("at")).join(v.v_pages.select(F.col("pos").alias("at"), "title"), "at").select("id", "title")
        .unionByName(v.v_pages.select("id", F.concat(F.lit("Missing "), F.col("title")).alias("title"))),
    ).select("id", "title", "target_id")
)
_USER_REFS = f"""(SELECT id, 'username' AS kind, unnest({D.extract_all('html', R.USERNAME_LINK, 1, 'i')}) AS key FROM v_storage
 UNION SELECT id, 'userkey', unnest({D.extract_all('html', R.USERKEY_LINK, 1, 'i')}) FROM v_storage)"""


def _user_refs(v: Views) -> DataFrame:
    return refs.page_refs(_storage(v)).where(F.col("kind").isin("username", "userkey"))


add("distinct_users", f"SELECT DISTINCT kind, key FROM {_USER_REFS}", "v_storage")(lambda v: refs.distinct_users(_user_refs(v)))
add(
    "resolve_users",
    f"""SELECT r.id, r.kind, r.key, '@' || coalesce(u.display_name, k.display_name, CASE WHEN r.kind = 'username' THEN r.key ELSE 'user-' || right(r.key, 8) END) AS label
 FROM {_USER_REFS} r LEFT JOIN v_users u ON r.kind = 'username' AND u.username = r.key LEFT JOIN v_users k ON r.kind = 'userkey' AND k.user_key = r.key""",
    "v_storage", "v_users",
)(lambda v: refs.resolve_users(_user_refs(v), v.v_users).select("id", "kind", "key", "label"))
add(
    "child_lists",
    f"SELECT parent_id, string_agg({D.child_link('title')}, chr(10) ORDER BY pos) || chr(10) || chr(10) AS list FROM v_tree WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "v_tree",
)(lambda v: refs.child_lists(v.v_tree))
add(
    "assemble_page",
    "SELECT CAST(user_id AS VARCHAR) AS id, string_agg(event_type, '; ' ORDER BY event_id) AS text FROM events GROUP BY 1",
)(
    lambda v: refs.assemble_page(
        v.events.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("s")), "; "
    )
)
add(
    "match_ordinal",
    f"""SELECT id, CAST(i AS INT) AS ordinal, found[i + 1] AS text FROM (SELECT id, {D.extract_all('html', R.ANCHOR, 1, 'i')} AS found FROM v_storage), LATERAL (SELECT unnest(range(len(found))) AS i)""",
    "v_storage",
)(lambda v: refs.match_ordinal(v.v_storage, R.ANCHOR))
_TARGETED = f"""(SELECT s.id, t, d.targets[t] AS target, d.included[t] AS txt FROM (SELECT id, {D.macro_title(D.extract('html', R.INCLUDE_MACRO, 0, 'i'))} AS t FROM v_storage) s, dims d)"""
add(
    "resolve_includes",
    cte(f"{_DIMS} SELECT id, t AS key, txt AS value FROM {_TARGETED} WHERE t <> '' AND target IS NOT NULL AND target <> id"),
    "v_storage", "v_users",
)(
    lambda v: refs.resolve_refs(_storage(v), _page_index(v), v.v_users).where(F.col("kind") == "include").select("id", "key", "value")
)
add(
    "include_list",
    f"SELECT id, chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || {D.join(D.include_items('html'), chr(10))} || chr(10) || chr(10) AS list FROM v_storage",
    "v_storage",
)(
    lambda v: v.v_storage.select(
        "id", refs.include_text(F.col("title"), F.array_join(refs.include_items(F.col("html")), "\n")).alias("list")
    )
)
_CHILD = D.expand_children("s.html", "d.by_title", "d.own[s.id]")
add("expand_children", _stage_sql(_CHILD), "v_storage", "v_users")(lambda v: refs.expand_children(_storage(v), _page_index(v)))
add("expand_list_children", _stage_sql(D.expand_list_children("s.html", "d.own[s.id]")), "v_storage", "v_users")(
    lambda v: refs.expand_list_children(_storage(v), _page_index(v))
)
add("expand_includes", _stage_sql(D.let(_KNOWN, lambda k: D.fill_includes(D.mark_includes("s.html", k), k))), "v_storage", "v_users")(
    lambda v: refs.expand_includes(_storage(v), _page_index(v), v.v_users)
)
add("include_items", f"SELECT id, {D.join(D.include_items('html'), chr(10))} AS items FROM v_storage", "v_storage")(
    lambda v: v.v_storage.select("id", F.array_join(refs.include_items(F.col("html")), "\n").alias("items"))
)
add("link_users", _stage_sql(D.link_users("s.html", "d.by_name", "d.by_key")), "v_storage", "v_users")(
    lambda v: refs.link_users(_storage(v), v.v_users)
)
add("link_pages", f"SELECT id, {D.link_pages('html')} AS html FROM v_storage", "v_storage")(
    lambda v: refs.link_pages(_storage(v), _page_index(v))
)
add("link_pages_resolved", _stage_sql(D.link_pages("s.html", "d.files")), "v_storage", "v_users")(
    lambda v: refs.link_pages(_storage(v), _page_index(v), resolved=True)
)

# ---- conversion stages ------------------------------------------------------------------------------------


def _stage_key(key: str, spark_fn, duck_fn, source: str = "html", spark_source=None) -> None:
    add(key, f"SELECT id, {duck_fn(source)} AS html FROM v_storage", "v_storage")(
        lambda v: v.v_storage.select("id", spark_fn(spark_source() if spark_source else F.col("html")).alias("html"))
    )


_stage_key("normalize_newlines", M.normalize_newlines, D.newlines, "replace(html, '>', '>' || chr(13) || chr(10))", lambda: F.replace(F.col("html"), F.lit(">"), F.lit(">\r\n")))
_stage_key("flatten_cell_lists", M.flatten_cell_lists, D.flatten_cell_lists)
_stage_key("unwrap_tables", M.unwrap_tables, D.unwrap_tables)
_stage_key("convert_macros", M.convert_macros, D.convert_macros)
_stage_key("link_images", M.link_images, D.link_images)
_stage_key("drop_scripts", M.drop_scripts, lambda x: D.chain(x, R.DROP_RULES))
_stage_key("strip_layout", M.strip_layout, lambda x: D.chain(x, R.LAYOUT_RULES))
_stage_key("tables_to_markdown", M.tables_to_markdown, D.tables)
_stage_key("trim_table_cells", M.trim_table_cells, D.trim_cells, "concat('|  a | ', title, '  |', chr(10), html)", lambda: F.concat(F.lit("|  a | "), F.col("title"), F.lit("  |\n"), F.col("html")))
_stage_key("html_to_markdown", M.html_to_markdown, D.html_to_markdown)
_ESCAPED = r"concat('\[', title, '\](', id, '.md\) !\[', title, '\]( images/a.png ) \[', title, '\](b) ', html)"
_stage_key("restore_links", M.restore_links, D.restore_links, _ESCAPED, lambda: F.concat(
    F.lit("\\["), "title", F.lit("\\]("), "id", F.lit(".md\\) !\\["), "title", F.lit("\\]( images/a.png ) \\["), "title", F.lit("\\](b) "), "html"))
_stage_key("final_unescape", M.final_unescape, D.unescape, _ESCAPED, lambda: F.concat(
    F.lit("\\["), "title", F.lit("\\]("), "id", F.lit(".md\\) !\\["), "title", F.lit("\\]( images/a.png ) \\["), "title", F.lit("\\](b) "), "html"))
_stage_key("clean_markdown", M.clean_markdown, D.clean)

# ---- whole corpus ---------------------------------------------------------------------------------------------

_CONVERTED = f"""{_DIMS},
 s1 AS (SELECT s.id, s.title, {D.flatten_cell_lists(D.newlines('s.html'))} AS html, {_KNOWN} AS known FROM v_storage s, dims d),
 s2 AS (SELECT s.id, s.title, known, {D.expand_children('s.html', 'd.by_title', 'd.own[s.id]')} AS html FROM s1 s, dims d),
 s3 AS (SELECT s.id, s.title, known, {D.expand_list_children('s.html', 'd.own[s.id]')} AS html FROM s2 s, dims d),
 s4 AS (SELECT id, title, known, {D.unwrap_tables(D.mark_includes('html', 'known'))} AS html FROM s3),
 s5 AS (SELECT id, title, known, {D.convert_macros('html')} AS html FROM s4),
 s6 AS (SELECT s.id, s.title, known, {D.link_users('s.html', 'd.by_name', 'd.by_key')} AS html FROM s5 s, dims d),
 s7 AS (SELECT id, title, known, {D.link_pages('html')} AS html FROM s6),
 s8 AS (SELECT id, title, known, {D.link_images('html')} AS html FROM s7),
 s9 AS (SELECT id, title, known, {D.trim_cells(D.tables(D.strip_page('html')))} AS html FROM s8),
 s10 AS (SELECT id, title, {D.fill_includes('html', 'known')} AS html FROM s9),
 s11 AS (SELECT id, title, {D.finish('html')} AS html FROM s10)"""
_NAME = f"(id || '-' || {D.slug50('title')})"
_MARKDOWN = f"""SELECT id, {_NAME} || '.md' AS file,
 {D.unescape(f"({D.front_matter(D.unslug(_NAME), 'id')} || chr(10) || chr(10) || html)")} AS markdown FROM s11"""


def _corpus(v: Views, options: refs.MarkdownOptions = refs.MarkdownOptions()) -> DataFrame:
    return refs.pages_to_markdown(_storage(v), _page_index(v), v.v_users, options, tasks=_tasks(v))


add("pages_to_markdown", cte(f"{_CONVERTED} {_MARKDOWN}"), "v_storage", "v_users")(lambda v: _corpus(v).drop("images"))
_MANIFEST = f"""manifest AS (SELECT id AS page_id, CAST(i AS INT) AS pos, found[i + 1].kind AS kind, found[i + 1].container_id AS container_id, found[i + 1].name AS name
 FROM (SELECT id, {D.image_refs('html', 'id')} AS found FROM s7), LATERAL (SELECT unnest(range(len(found))) AS i))"""


def _manifest(v: Views) -> DataFrame:
    return refs.image_manifest(_corpus(v))


add("image_manifest", cte(f"{_CONVERTED}, {_MANIFEST} SELECT *, {D.image_file('name')} AS slug_name FROM manifest"), "v_storage", "v_users")(_manifest)
_CANDIDATES = f"""CASE WHEN m.kind = 'storage' THEN [m.name, {D.encode_uri('m.name')}] ELSE
 list_filter([m.name, {D.decode_uri('m.name')}, {D.simple_name('m.name')}], lambda c: c IS NOT NULL AND c <> '') END"""
_RESOLVED = f"""tries AS (SELECT m.*, {_CANDIDATES} AS names FROM manifest m),
 hits AS (SELECT t.page_id, t.pos, min(n) AS n FROM tries t, LATERAL (SELECT unnest(range(1, len(t.names) + 1)) AS n) JOIN v_attachments a ON a.page_id = t.container_id AND a.filename = t.names[n] GROUP BY ALL),
 resolved AS (SELECT t.page_id, t.pos, t.kind, t.container_id, t.name, {D.image_file('t.name')} AS slug_name, t.names[h.n] AS filename, a.content, h.n IS NOT NULL AS found
 FROM tries t LEFT JOIN hits h ON h.page_id = t.page_id AND h.pos = t.pos LEFT JOIN v_attachments a ON a.page_id = t.container_id AND a.filename = t.names[h.n])"""
add("resolve_attachments", cte(f"{_CONVERTED}, {_MANIFEST}, {_RESOLVED} SELECT * FROM resolved"), "v_storage", "v_users", "v_attachments")(
    lambda v: refs.resolve_attachments(store(_manifest(v), "manifest"), v.v_attachments)
)

# ---- sources, sinks, streams: over files that Spark writes from the tables ----------------------------------------


def _scratch(v: Views, name: str) -> str:
    return f"{checkpoint_folder(v.pages.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _land(v: Views, stale: bool = False) -> str:
    """Write the current listing as listing responses of ``PAGE_SIZE`` pages; returns the folder.

    ``stale`` adds responses behind the end of the listing.
    """
    return _land_listing(v, v.v_current.join(v.v_pages.select("id", "html"), "id"), stale)


def _land_listing(v: Views, listed: DataFrame, stale: bool = False) -> str:
    """Write pages with their bodies as listing responses."""
    numbered = store(ix.batch_number(listed, PAGE_SIZE), "listing")
    when = F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    history = F.col("pos") % 2 == 1
    item = F.struct(
        "id",
        "title",
        F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"),
        F.struct(F.col("version").alias("number"), F.when(history, "").otherwise(when).alias("when")).alias("version"),
        F.when(F.col("parent_id").isNotNull(), F.array(F.struct(F.lit("top").alias("id")), F.struct(F.col("parent_id").alias("id")))).alias("ancestors"),
        F.struct(F.struct(F.when(history, when).alias("when")).alias("lastUpdated")).alias("history"),
    )
    last = numbered.select(F.max("batch_no")).first()[0] or 0
    envelopes = numbered.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("items")).select(
        F.lit(SPACE).alias("space"),
        F.transform("items", lambda i: i["item"]).alias("results"),
        ((F.col("batch_no") - 1) * PAGE_SIZE).alias("start"),
        F.lit(PAGE_SIZE).cast("bigint").alias("limit"),
        F.size("items").cast("bigint").alias("size"),
        F.struct(F.when(F.col("batch_no") < last, "more").alias("next")).alias("_links"),
    )
    if stale:
        envelopes = envelopes.unionByName(envelopes.withColumn("start", F.col("start") + 1_000_000))
    path = _scratch(v, "landing")
    envelopes.repartition(max(4, -(-last // FILE_RESPONSES)), "start").write.json(path)
    return path


_LISTED = f"listed AS (SELECT c.*, p.html, CAST(row_number() OVER (ORDER BY c.pos) - 1 AS BIGINT) AS n FROM v_current c JOIN v_pages p ON p.id = c.id)"
_PAGE_SQL = f"SELECT '{SPACE}' AS space, n AS pos, CAST(n // {PAGE_SIZE} + 1 AS INT) AS api_page_number, id, title, {{body}}version, parent_id, modified_at FROM listed"

add("scan_page_envelopes", cte(f"{_LISTED} {_PAGE_SQL.format(body='html AS body, ')}"), "v_pages", "v_current")(
    lambda v: readers.scan_page_envelopes(v.pages.sparkSession, _land(v))
)
add("scan_page_metadata", cte(f"{_LISTED} {_PAGE_SQL.format(body='')}"), "v_pages", "v_current")(
    lambda v: readers.scan_page_metadata(v.pages.sparkSession, _land(v, stale=True))
)
add("flatten_page", cte(f"{_LISTED} {_PAGE_SQL.format(body='html AS body, ')}"), "v_pages", "v_current")(
    lambda v: readers.flatten_page(readers.read_envelopes(v.pages.sparkSession, _land(v)))
)
add(
    "envelope_cutoff",
    cte(f"{_LISTED} SELECT '{SPACE}' AS space, n // {PAGE_SIZE} * {PAGE_SIZE} AS start, count(*) AS size FROM listed GROUP BY ALL"),
    "v_pages", "v_current",
)(lambda v: readers.envelope_cutoff(readers.read_envelopes(v.pages.sparkSession, _land(v, stale=True))).select("space", "start", "size"))
add("search_pages", cte(f"{_LISTED} {_PAGE_SQL.format(body='')} WHERE modified_at >= TIMESTAMP '2024-01-20 00:00:00'"), "v_pages", "v_current")(
    lambda v: readers.scan_search_results(readers.scan_page_metadata(v.pages.sparkSession, _land(v)), SPACE, F.lit("2024-01-20 13:00:00").cast("timestamp_ntz"))
)


def _user_rows(v: Views) -> DataFrame:
    return v.v_users.select(
        F.col("user_key").alias("userKey"), "username", F.col("display_name").alias("displayName"),
        F.concat(F.col("username"), F.lit("@example.com")).alias("email"),
    )


def _users_file(v: Views) -> str:
    path = _scratch(v, "users")
    _user_rows(v).write.json(path)
    return path


def _user_cache(v: Views) -> str:
    """Cache files of a bounded number of users each, names and keys in turn."""
    path = _scratch(v, "user-cache")
    user = F.struct("userKey", "username", "displayName", "email")
    entries = _user_rows(v).withColumn("file", F.expr("cast(substring_index(username, '.', -1) as bigint) div 500")).select(
        "file", F.explode(F.array(F.struct(F.col("username").alias("k"), user.alias("u")), F.struct(F.concat(F.lit("key:"), F.col("userKey")).alias("k"), user.alias("u")))).alias("e")
    )
    files = entries.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    return path


add("scan_users", "SELECT *, username || '@example.com' AS email FROM v_users", "v_users")(
    lambda v: readers.scan_users(v.pages.sparkSession, _users_file(v))
)
add(
    "scan_user_cache",
    """SELECT 'username' AS key_kind, username AS key, username, display_name, username || '@example.com' AS email FROM v_users
 UNION ALL SELECT 'userkey', user_key, username, display_name, username || '@example.com' FROM v_users""",
    "v_users",
)(lambda v: readers.scan_user_cache(v.pages.sparkSession, _user_cache(v)))


def _written(df: DataFrame, root: str) -> str:
    sinks.write_files(df, root).agg(F.sum("bytes")).collect()
    return root


def _html_tree(v: Views) -> str:
    return _written(v.v_html_files.withColumn("id", F.regexp_extract("path", r"/(\d+)-page", 1)).join(_id_pages(v), "id").select("path", F.col("html").alias("content")), _scratch(v, "tree"))


add("scan_html_tree", "SELECT h.path, CAST(p.page_id AS VARCHAR) AS id, p.html FROM pages p JOIN v_html_files h ON regexp_extract(h.path, '/([0-9]+)-page', 1) = CAST(p.page_id AS VARCHAR)", "v_html_files")(
    lambda v: readers.scan_html_tree(v.pages.sparkSession, _html_tree(v))
)
add("scan_markdown_tree", "SELECT path FROM v_md_files", "v_md_files")(
    lambda v: readers.scan_markdown_tree(
        v.pages.sparkSession,
        _written(
            v.v_md_files.unionByName(v.v_md_files.select(F.regexp_replace("path", "^out/", "out/links/").alias("path")))
            .unionByName(v.v_md_files.select(F.regexp_replace("path", "/([^/]+)$", "/_$1").alias("path"))).withColumn("content", F.col("path")),
            _scratch(v, "tree"),
        ),
    )
)
add("scan_attachments", "SELECT page_id, filename, content FROM v_attachments", "v_attachments")(
    lambda v: readers.scan_attachments(
        v.pages.sparkSession,
        _written(v.v_attachments.select(F.concat_ws("/", "page_id", "filename").alias("path"), "content"), _scratch(v, "files")),
    )
)
def _sidecar_tree(v: Views) -> str:
    state = F.to_json(F.struct(
        F.col("page_id").alias("pageId"), "version",
        F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("modifiedDate"),
        F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("downloadedAt"),
    ))
    return _written(v.v_sidecars.select("path", state.alias("content")), _scratch(v, "tree"))


add("scan_meta_sidecars", "SELECT path, page_id, version, downloaded_at AS modified_at, downloaded_at FROM v_sidecars", "v_sidecars")(
    lambda v: readers.scan_meta_sidecars(v.pages.sparkSession, _sidecar_tree(v))
)


def _run_key(key: str, sql: str, views: tuple[str, ...], frame, write) -> None:
    def run(v: Views) -> DataFrame:
        table = _scratch(v, key)
        write(frame(v), table)
        return sinks.read_latest(v.pages.sparkSession, table, SPACE)

    add(key, sql, *views)(run)


_run_key("write_index", f"SELECT {_INDEX} FROM v_index", ("v_index",), lambda v: v.v_index.select(*INDEX_COLUMNS), lambda df, t: sinks.write_index(df, t, SPACE, 1, NOW))
_run_key("write_queue", f"SELECT {_META}, status AS queue_reason FROM ({_STATUS}) WHERE status <> 'skip'", ("v_current", "v_index"), lambda v: ix.queue_status(v.v_current, v.v_index), lambda df, t: sinks.write_queue(df, t, SPACE, 1, NOW))


@add("write_tree", cte(f"{_RANKS} SELECT id, parent_id, title, root_id, depth, array_to_string(path, '.') AS path FROM forest"), "v_tree")
def _write_tree(v: Views) -> DataFrame:
    table = _scratch(v, "tree")
    sinks.write_tree(tree.build_forest(v.v_tree), table, SPACE, 1, NOW)
    return _path_text(sinks.read_latest(v.pages.sparkSession, table, SPACE))


@add("index_runs", f"SELECT '{SPACE}' AS space, CAST(1 AS BIGINT) AS run_id, {_NOW_SQL} AS export_date, 100 AS page_size, count(*) AS total_rows FROM v_index", "v_index")
def _index_runs(v: Views) -> DataFrame:
    table = _scratch(v, "runs")
    sinks.write_index(v.v_index, table, SPACE, 1, NOW)
    return sinks.read_runs(v.pages.sparkSession, table, SPACE)


_LOGGED = f"""changed AS (SELECT * FROM ({_DIFF}) WHERE change IN ('new', 'updated'))
 SELECT c.id, CASE WHEN d.id IS NULL THEN i.version ELSE c.version END AS version, CASE WHEN d.id IS NULL THEN 1 WHEN d.change = 'new' THEN 2 ELSE 3 END AS run
 FROM v_current c LEFT JOIN v_index i ON i.id = c.id LEFT JOIN changed d ON d.id = c.id"""


def _logged(v: Views) -> str:
    """The index as run 1, new pages and removals as run 2, updated pages as run 3; merged in between and at the end."""
    spark, table = v.pages.sparkSession, _scratch(v, "log")
    found = store(ix.diff_snapshots(v.v_current, v.v_index), "diff")

    def current(change: str) -> DataFrame:
        return v.v_current.join(found.where(F.col("change") == change), "id", "left_semi").select("id", "version")

    removed = found.where(F.col("change") == "deleted")
    changes.write_changes(v.v_index.select("id", "version"), table, SPACE, 1, NOW)
    changes.write_changes(current("new"), table, SPACE, 2, NOW, removed)
    changes.compact(spark, table, SPACE)
    changes.write_changes(current("updated"), table, SPACE, 3, NOW)
    return table


add("read_current", cte(_LOGGED), "v_current", "v_index")(
    lambda v: changes.read_current(v.pages.sparkSession, _logged(v), SPACE)
)


@add("merge_runs", cte(_LOGGED), "v_current", "v_index")
def _merge_runs(v: Views) -> DataFrame:
    """The rows of the one segment that all runs are merged into, read after the runs were deleted."""
    spark, table = v.pages.sparkSession, _logged(v)
    changes.compact(spark, table, SPACE, whole=True)
    changes.retire(spark, table, SPACE, keep=1)
    return changes.read_current(spark, table, SPACE)


def _page_files(v: Views) -> DataFrame:
    return tree.page_paths(tree.with_names(_page_index(v)), ROOT)


def _read_back(v: Views, write) -> DataFrame:
    """What ``write(root)`` has written: the path, size and checksum of each file."""
    root = _scratch(v, "files")
    write(root).agg(F.sum("bytes")).collect()
    return files.read_files(v.pages.sparkSession, root).select("path", "bytes", F.md5("content").alias("content"))


add("write_html", cte(f"{_PATHS} SELECT t.child_dir || '.html' AS path, CAST(strlen(p.html) AS BIGINT) AS bytes, md5(p.html) AS content FROM paths t JOIN v_pages p ON p.id = t.id"), "v_pages")(
    lambda v: _read_back(v, lambda root: sinks.write_html(_id_pages(v), _page_files(v), root))
)
add(
    "write_markdown",
    cte(f"{_CONVERTED}, {_PATHS} SELECT t.child_dir || '.md' AS path, CAST(strlen(m.markdown) AS BIGINT) AS bytes, md5(m.markdown) AS content FROM ({_MARKDOWN}) m JOIN paths t ON t.id = m.id"),
    "v_storage", "v_users",
)(lambda v: _read_back(v, lambda root: sinks.write_markdown(_corpus(v), _page_files(v), root)))
add(
    "write_images",
    cte(f"""{_CONVERTED}, {_MANIFEST}, {_RESOLVED}, {_PATHS} SELECT path, CAST(strlen(content) AS BIGINT) AS bytes, md5(content) AS content FROM (
 SELECT t.dir || '/images/' || r.slug_name AS path, arg_min(r.content, r.page_id || ' ' || lpad(CAST(r.pos AS VARCHAR), 9, '0')) AS content FROM resolved r JOIN paths t ON t.id = r.page_id WHERE r.found GROUP BY ALL)"""),
    "v_storage", "v_users", "v_attachments",
)(
    lambda v: _read_back(
        v, lambda root: sinks.write_images(refs.resolve_attachments(store(_manifest(v), "manifest"), v.v_attachments), _page_files(v), root)
    )
)

# ---- incremental jobs ---------------------------------------------------------------------------------------------------

_FRESH = f"SELECT n AS pos, id, title, version, parent_id, modified_at, {_NOW_SQL} AS indexed_at, {{page}} AS page_number, CAST(NULL AS INT) AS downloaded_version, CAST(NULL AS TIMESTAMP) AS downloaded_at FROM listed"


@add("stream_index_ingest", cte(f"{_LISTED} {_FRESH.format(page=f'CAST(n // {PAGE_SIZE} + 1 AS INT)')}"), "v_pages", "v_current")
def _stream_ingest(v: Views) -> DataFrame:
    spark, table = v.pages.sparkSession, _scratch(v, "ingested")
    streams.stream_index_ingest(spark, _land(v), _scratch(v, "progress"), table, SPACE, NOW, files_per_batch=1).awaitTermination()
    return spark.read.parquet(table)


@add("stream_index_upsert", cte(f"{_LISTED} SELECT n AS pos, id, title, version, parent_id, modified_at, {_NOW_SQL} AS indexed_at, CAST(NULL AS INT) AS downloaded_version, CAST(NULL AS TIMESTAMP) AS downloaded_at FROM listed"), "v_pages", "v_current")
def _stream_upsert(v: Views) -> DataFrame:
    spark, table = v.pages.sparkSession, _scratch(v, "upserted")
    streams.stream_index_upsert(spark, _land(v), _scratch(v, "progress"), table, SPACE, NOW, files_per_batch=2).awaitTermination()
    return streams.read_upserted(spark, table, SPACE).drop("page_number")


def _page_markdown_sql(source: str) -> str:
    """Pages without wiki markup: the text rules and the front matter."""
    body = D.convert_plain(D.newlines("html"))
    return f"SELECT id, {D.unescape(f'''({D.front_matter(D.unslug(_NAME), 'id')} || chr(10) || chr(10) || {body})''')} AS markdown FROM {source}"


@add("stream_transform", cte(f"{_LISTED} {_page_markdown_sql('listed')}"), "v_pages", "v_current")
def _stream_transform(v: Views) -> DataFrame:
    spark, table = v.pages.sparkSession, _scratch(v, "converted")
    streams.stream_transform(
        spark, _land(v), _scratch(v, "progress"), table, SPACE, store(_page_index(v), "page-index"), store(v.v_users, "users"), files_per_batch=2
    ).awaitTermination()
    return streams.read_transformed(spark, table).select("id", "markdown")


@add("sync_corpus", cte(f"{_LISTED} {_page_markdown_sql('listed')}"), "v_pages", "v_current")
def _sync(v: Views) -> DataFrame:
    spark = v.pages.sparkSession
    options = SyncOptions(space=SPACE, landing=_land(v), tables=_scratch(v, "tables"), now=NOW)
    return sync_corpus(spark, options, v.v_users).select("id", "markdown")


@add("sync_upkeep", cte(f"{_CONVERTED} {_MARKDOWN}"), "v_storage", "v_users")
def _sync_upkeep(v: Views) -> DataFrame:
    """All Markdown after two syncs, of which the second finds new bodies for a tenth of the pages, and upkeep of the tables: equal to one conversion of all."""
    spark = v.pages.sparkSession
    pages = _storage(v).join(v.v_pages.select("id", "pos", "parent_id"), "id")
    edited = F.col("pos") % 10 == 4
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    before = pages.withColumn("html", F.when(edited, "<p>draft</p>").otherwise(F.col("html"))).withColumns({"version": F.lit(1), "modified_at": when})
    after = pages.withColumns({"version": F.when(edited, 2).otherwise(1), "modified_at": when})
    options = SyncOptions(space=SPACE, landing=_land_listing(v, before), tables=_scratch(v, "tables"), now=NOW)
    sync_corpus(spark, options, v.v_users)
    sync_corpus(spark, replace(options, landing=_land_listing(v, after)), v.v_users)
    maintain(spark, options)
    return current_table(spark, options, "markdown").select("id", "file", "markdown")


@add("transform_stored", cte(f"{_LISTED} {_page_markdown_sql('listed')}"), "v_pages", "v_current")
def _transform_stored(v: Views) -> DataFrame:
    """All Markdown after a sync and a limited second conversion: runs of changes read as one table."""
    spark = v.pages.sparkSession
    options = SyncOptions(space=SPACE, landing=_land(v), tables=_scratch(v, "tables"), now=NOW)
    sync_corpus(spark, options, v.v_users)
    transform_stored(spark, replace(options, force=True, limit=25), v.v_users)
    return current_table(spark, options, "markdown").select("id", "markdown")


@add("migrate_sidecars", f"""SELECT i.id, coalesce(s.version, i.downloaded_version) AS downloaded_version, coalesce(s.downloaded_at, i.downloaded_at) AS downloaded_at FROM v_index i
 LEFT JOIN (SELECT page_id, arg_max(version, path) AS version, arg_max(downloaded_at, path) AS downloaded_at FROM v_sidecars GROUP BY page_id) s ON s.page_id = i.id""", "v_index", "v_sidecars")
def _migrate_sidecars(v: Views) -> DataFrame:
    spark = v.pages.sparkSession
    options = SyncOptions(space=SPACE, landing="", tables=_scratch(v, "tables"), now=NOW)
    sinks.write_index(v.v_index.select(*INDEX_COLUMNS), f"{options.tables}/page_index", SPACE, 1, NOW)
    migrate_sidecars(spark, options, _sidecar_tree(v))
    return sinks.read_latest(spark, f"{options.tables}/page_index", SPACE).select("id", "downloaded_version", "downloaded_at")
