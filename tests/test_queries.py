"""The registry is complete, and its cheap queries equal their statements (all: ``python -m checks.compare``)."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import check, connect

SMALL = "/root/testdata/sf0.001"
CHEAP = [
    "slugify", "unslugify", "split_extension", "encode_uri", "decode_uri", "simple_name", "page_status", "diff_snapshots",
    "upsert_modified", "union_upsert", "rebuild_index", "queue_status", "merge_sidecars", "sidecar_stats", "skipped_sidecars",
    "root_pages", "attach_parent", "child_pages", "site_tree", "first_by_title", "child_lists", "assemble_page", "convert_macros",
    "link_images", "tables_to_markdown", "clean_markdown", "html_to_markdown", "flatten_cell_lists",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_registry():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 115
    assert all(callable(q) for q in queries.values())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["id", "markdown"] and df.count() == 50


@pytest.mark.parametrize("key", CHEAP)
def test_equals_statement(spark, con, key):
    verdict, _, rows, detail = check(spark, con, SMALL, key)
    assert verdict == "ok" and rows > 0, detail




def test_entry_without_the_optional_parts(tmp_path):
    """A copy of the tree without llm, and one without the pipeline as well, imports and runs a query of the rest."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("wikitables", "checks"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copy(root / "bench.py", tmp_path)
    code = (
        "import __spark_entry__ as e; from bench import session; "
        f"q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print('rows', q['slugify'](session(), {SMALL!r}).count())"
    )
    pipeline = root / "corpus_pipeline.py"
    for part in [pipeline, None] if pipeline.exists() else [None]:
        if part is not None:
            shutil.copy(part, tmp_path)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert "rows 50" in done.stdout, done.stderr[-2000:]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
