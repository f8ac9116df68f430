"""The registry: it imports without the training-data subpackage, and its queries give what their SQL gives."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from inkstone.plans import queries as own

DATA = "/root/testdata/sf0.001"


def test_imports_without_llm():
    code = "import sys; sys.modules['inkstone.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'page_assembly' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), timeout=120).returncode == 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(own.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got, want = own.QUERIES[name](spark, DATA).toPandas(), db.execute(own.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [x[cols].astype(object).where(x[cols].notna(), None).map(str).sort_values(cols).reset_index(drop=True) for x in (got, want)]
    assert rows[0].equals(rows[1])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
