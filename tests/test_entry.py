from __future__ import annotations

import ast
import pathlib
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import plain
from tests.conftest import SF, needs_data

ROOT = pathlib.Path(entry.__file__).parent


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    for path in ROOT.joinpath("lensmill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    """Every registered query over the smallest tables; those with SQL row by row."""
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    found = tables.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == columns
    assert got == sorted((plain(tuple(r[i] for i in order)) for r in found.fetchall()), key=repr)


def test_other_queries_stay_without_the_text_queries():
    """A missing dependency of the text operators leaves all others."""
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; names = e.queries(); assert 'p1_found' in names and 'p8_ids' not in names"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
