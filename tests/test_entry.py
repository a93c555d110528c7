"""The driver contract: names, oracle agreement on the smallest tables, no forbidden imports."""

import glob
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def _text(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.4f}"
    return str(v)


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    for p in (ROOT / "almudi").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"almudi\.llm|from \.+llm", p.read_text()), p


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql(llm=False)))
def test_against_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(_text(v) for _, v in sorted(zip(cols, r, strict=True))) for r in cur.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(tuple(_text(v) for v in r) for r in df.select(*sorted(cols)).collect())
    assert got == want


def test_llm_that_cant_be_imported_costs_no_other_query(monkeypatch):
    import builtins
    import sys

    rest = set(entry.queries())
    own = {k for k in rest if k in getattr(sys.modules.get(entry._LLM), "QUERIES", {})}
    for m in [m for m in sys.modules if m == "almudi.llm" or m.startswith("almudi.llm.")]:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def blocked(name, *args, **kw):
        if name in ("ahocorasick", "tiktoken"):
            raise ImportError(name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", blocked)
    assert set(entry.queries()) == rest - own
