"""Derived inputs, written once for Spark and DuckDB.

The driver's tables hold no page index and no wiki markup, so both are derived
from whole tables: revisions are the events of the user with the page's number,
the stored index is the state before a cut-off, the current listing the state
now.  What differs between the two follows from the kind of each page's first
and last event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "orders", "events", "pages"]

_NOTE = '<ac:structured-macro ac:name="note"><ac:rich-text-body>Mind the gap</ac:rich-text-body></ac:structured-macro>'
_MACROS = [
    (3, _NOTE),
    (4, '<table><tr><th>k</th><th> v </th></tr><tr><td>x<ul><li>one</li><li>two</li></ul></td><td>a|b</td></tr></table>'),
    (5, '<ac:structured-macro ac:name="list-children"></ac:structured-macro>'),
    (6, '<ac:structured-macro ac:name="toc" />Between<ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">A-1</ac:parameter></ac:structured-macro>'),
    (7, '<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[x = 1;]]></ac:plain-text-body></ac:structured-macro>and<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[y = 2]]></ac:plain-text-body></ac:structured-macro>'),
    (8, '<ac:structured-macro ac:name="info"><ac:parameter ac:name="title"> Hint </ac:parameter><ac:rich-text-body><p>Read on</p></ac:rich-text-body></ac:structured-macro>'),
    (9, '<ac:structured-macro ac:name="panel"><ac:rich-text-body>Outer <ac:structured-macro ac:name="panel"><ac:rich-text-body>inner</ac:rich-text-body></ac:structured-macro> text</ac:rich-text-body></ac:structured-macro>'),
    (10, '<ac:layout><ac:layout-section><ac:layout-cell><p>Due <time datetime="2024-02-01" /></p></ac:layout-cell></ac:layout-section></ac:layout>'),
    (11, '<ac:structured-macro ac:name="warning"><ac:rich-text-body>Hot</ac:rich-text-body></ac:structured-macro><ac:structured-macro ac:name="gallery" />'),
    (12, '<ac:structured-macro ac:name="children"></ac:structured-macro>'),
    (13, '<ac:structured-macro ac:name="table-filter"><ac:rich-text-body><table><tbody><tr><td>only</td></tr></tbody></table></ac:rich-text-body></ac:structured-macro>'),
]


def _storage_sql() -> str:
    pieces = "".join(f", CASE WHEN p.pos%{n}=0 THEN '{text}' ELSE '' END" for n, text in _MACROS)
    return f"""SELECT p.pos, p.id, p.title, p.parent_id, concat(p.html,
 '<p><ac:link><ri:user ri:username="user.', p.pos, '" /></ac:link> and <ac:link><ri:user ri:userkey="ff8080817b', p.pos*3, '" /></ac:link></p>',
 '<p><ac:link><ri:page ri:content-title="', coalesce(q.title,'Missing Page'), '" /></ac:link> or <ri:page ri:content-title="See $1 also" /></p>',
 '<ac:image><ri:attachment ri:filename="Chart ', p.pos%9, '.png" /></ac:image>',
 '<img class="x" src="/download/attachments/', p.pos, '/pic%20', p.pos%9, '.png?version=1" data-linked-resource-container-id="', p.pos, '" />',
 CASE WHEN p.pos%6=1 THEN concat('<ac:structured-macro ac:name="include"><ri:page ri:content-title="', coalesce(q.title,'Missing Page'), '" /></ac:structured-macro>') ELSE '' END,
 CASE WHEN p.pos%7=3 THEN concat('<ac:structured-macro ac:name="children"><ri:page ri:content-title="', coalesce(q.title,'Missing Page'), '" /></ac:structured-macro>') ELSE '' END{pieces}) AS html
 FROM v_pages p LEFT JOIN v_pages q ON q.pos = p.pos+7"""


# {STR} string type, {DIV} integer division, {NTZ} timestamp literal prefix, {MINBY}/{MAXBY} the arg-min/max aggregates.
VIEWS: dict[str, str] = {
    "v_pages": """SELECT page_id AS pos, CAST(page_id AS {STR}) AS id, regexp_extract(html,'<title>(.*?)</title>',1) AS title,
 CASE WHEN page_id=0 THEN NULL WHEN page_id%17=0 THEN CAST(page_id+1000000 AS {STR}) ELSE CAST(((page_id-1) {DIV} 4) AS {STR}) END AS parent_id, url, html FROM pages""",
    "v_history": """SELECT e.user_id AS pos, CAST(count(*) AS INT) AS n_all, CAST(sum(CASE WHEN e.ts < {NTZ} '2024-01-16 00:00:00' THEN 1 ELSE 0 END) AS INT) AS n_before,
 max(e.ts) AS m_all, max(CASE WHEN e.ts < {NTZ} '2024-01-16 00:00:00' THEN e.ts END) AS m_before,
 {MINBY}(e.event_type, e.ts) AS first_type, {MAXBY}(e.event_type, e.ts) AS last_type FROM events e GROUP BY e.user_id""",
    "v_index": """SELECT p.pos, p.id, p.title, CASE WHEN h.first_type='signup' AND h.last_type='view' THEN NULL ELSE h.n_before END AS version, p.parent_id, h.m_before AS modified_at,
 {NTZ} '2024-01-16 00:00:00' AS indexed_at, CAST((p.pos {DIV} 100)+1 AS INT) AS page_number,
 CASE h.first_type WHEN 'view' THEN NULL WHEN 'click' THEN h.n_before WHEN 'purchase' THEN h.n_before-1 ELSE 0 END AS downloaded_version,
 CASE WHEN h.first_type='view' THEN NULL ELSE {NTZ} '2024-01-10 00:00:00' END AS downloaded_at
 FROM v_pages p JOIN v_history h ON p.pos=h.pos WHERE h.n_before > 0 AND h.first_type <> 'error'""",
    "v_current": """SELECT p.pos, p.id, p.title, CASE WHEN h.last_type='view' THEN h.n_before ELSE h.n_all END AS version, p.parent_id,
 CASE WHEN h.last_type='view' THEN h.m_before ELSE h.m_all END AS modified_at
 FROM v_pages p LEFT JOIN v_history h ON p.pos=h.pos WHERE coalesce(h.last_type,'') <> 'purchase'""",
    "v_tree": """SELECT concat('R',r_regionkey) AS id, CAST(NULL AS {STR}) AS parent_id, r_name AS title, CAST(r_regionkey AS BIGINT) AS pos FROM region
 UNION ALL SELECT concat('N',n_nationkey), concat('R',n_regionkey), n_name, CAST(100+n_nationkey AS BIGINT) FROM nation
 UNION ALL SELECT concat('C',c_custkey), concat('N',c_nationkey), c_name, 1000+c_custkey FROM customer
 UNION ALL SELECT concat('O',o_orderkey), concat('C',o_custkey), concat('Order ',o_orderkey), 100000000+o_orderkey FROM orders""",
    "v_users": """SELECT concat('ff8080817b',c_custkey) AS user_key, concat('user.',c_custkey) AS username, c_name AS display_name FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "v_storage": _storage_sql(),
    "v_attachments": """SELECT p.id AS page_id, concat('Chart ', p.pos%9, '.png') AS filename, concat('bytes-', p.id) AS content FROM v_pages p WHERE p.url LIKE 'https%'
 UNION ALL SELECT p.id, concat('pic ', p.pos%9, '.png'), concat('inline-', p.id) FROM v_pages p WHERE p.url LIKE 'http:%'""",
    "v_chains": """SELECT pos, id, title, CASE WHEN url LIKE 'https%' THEN lag(id) OVER (PARTITION BY left(url, 5), regexp_extract(url,'://([^/]+)',1) ORDER BY pos)
 ELSE coalesce(lag(id) OVER (PARTITION BY left(url, 5), regexp_extract(url,'://([^/]+)',1) ORDER BY pos), max(id) OVER (PARTITION BY left(url, 5), regexp_extract(url,'://([^/]+)',1))) END AS parent_id, url FROM v_pages""",
    "v_html_files": """SELECT concat('out/', replace(regexp_extract(url,'://([^/]+)',1), '.', '/'), '/', page_id, '-page.html') AS path FROM pages""",
    "v_md_files": """SELECT concat('out/', replace(regexp_extract(url,'://([^/]+)',1), '.', '/'), '/', page_id, '-page.md') AS path FROM pages WHERE length(html) > 3000""",
    "v_sidecars": """SELECT concat('meta/', lpad(CAST(event_id AS {STR}), 12, '0'), '.meta.json') AS path, CAST(user_id AS {STR}) AS page_id, CAST(event_id AS INT) AS version, ts AS downloaded_at FROM events WHERE event_type = 'purchase'""",
}
_DEPENDS = {
    "v_index": ["v_pages", "v_history"],
    "v_current": ["v_pages", "v_history"],
    "v_storage": ["v_pages"],
    "v_attachments": ["v_pages"],
    "v_chains": ["v_pages"],
}
_SPARK = {"STR": "STRING", "DIV": "DIV", "NTZ": "TIMESTAMP_NTZ", "MINBY": "min_by", "MAXBY": "max_by"}
_DUCK = {"STR": "VARCHAR", "DIV": "//", "NTZ": "TIMESTAMP", "MINBY": "arg_min", "MAXBY": "arg_max"}


def _render(text: str, dialect: dict[str, str]) -> str:
    for name, value in dialect.items():
        text = text.replace("{" + name + "}", value)
    return text


def needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for view in [*_DEPENDS.get(name, []), name]:
            if view not in out:
                out.append(view)
    return out


def duck_with(*names: str) -> str:
    """``WITH`` clauses for the named views, without the final statement."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_render(VIEWS[n], _DUCK)})" for n in needed(list(names)))


class Views:
    """The driver's tables and the derived views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            elif name in VIEWS:
                self._made[name] = self._derive(name)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _derive(self, name: str) -> DataFrame:
        sources = [t for t in TABLES if f" {t}" in VIEWS[name]] + _DEPENDS.get(name, [])
        text = _render(VIEWS[name], _SPARK)
        for source in sources:
            getattr(self, source).createOrReplaceTempView(source)
        return self._spark.sql(text)


QueryFn = Callable[[Views], DataFrame]
