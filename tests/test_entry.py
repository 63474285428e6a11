"""The driver's contract, and that the library stands without the operators for training data."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_llm_is_imported_by_nothing_else():
    for path in (ROOT / "strandmill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "strandmill").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 16 and {"token", "n", "utilization", "perplexity"} <= set(df.columns)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _canon(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_canon(y) for y in x)
    return x


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    wrong = []
    for name, sql in entry.oracle_sql().items():
        got = entry.queries()[name](spark, DATA)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        order = sorted(cols)
        want = [tuple(_canon(r[cols.index(c)]) for c in order) for r in cur.fetchall()]
        have = [tuple(_canon(r[c]) for c in order) for r in got.collect()] if sorted(got.columns) == order else None
        if have is None or sorted(have, key=repr) != sorted(want, key=repr):
            wrong.append(name)
    assert not wrong
