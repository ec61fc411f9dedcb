"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sortloom.plans import queries as core

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.01"


def test_flagship(spark):
    assert [r["p"] for r in entry.entry(spark).orderBy("p").collect()] == list(range(8))


def test_every_core_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", core.queries())
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(core.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    rows = lambda df: sorted(tuple(None if v is None or v != v else v for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_imports_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT / "sortloom", tmp_path / "sortloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql()) == sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    assert out.stdout.split() == [str(len(core.queries())), "True"]


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "sortloom", tmp_path / "sortloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "sortloom" / "llm").mkdir()
    (tmp_path / "sortloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "sortloom" / "llm" / "catalog.py").write_text("import no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert "no_such_module_at_all" in out.stderr
