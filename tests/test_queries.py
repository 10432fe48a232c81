"""Every query against its SQL on the smallest data; queries without SQL must run."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES = {k: q for k, q in entry.queries().items() if not (k[0] == "p" and k[1].isdigit())}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name in SQL:
        out = duck.sql(SQL[name])
        assert sorted(out.columns) == cols
        assert sorted(tuple(map(plain, r)) for r in out.select(*cols).fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() == 32


def test_core_does_without_the_corpus_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "lectern"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text())
