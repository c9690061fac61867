"""Every registered query against its DuckDB oracle, on the smallest tables."""

import math
import sys
from decimal import Decimal

import duckdb
import pytest
from auxograph import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    """Equal, numbers to 1e-5 of what they are (both sides round to 6 digits, which may go either way)."""
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)
    return a == b


def rows(values, names):
    """Rows with their columns in the order of names; sorted by what is no fraction, then by the rest."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(float(r[i]) if isinstance(r[i], Decimal) else r[i] for i in order) for r in values]
    key = lambda r: ([str(v) for v in r if not isinstance(v, float)], [f"{v:.4e}" for v in r if isinstance(v, float)])
    return sorted(plain, key=key)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    found = got.collect()
    want = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a, b = rows(found, got.columns), rows(want.fetchall(), names)
    assert a and len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))] == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_parts(monkeypatch):
    import __spark_entry__ as e

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("auxograph.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr("auxograph.__path__", [])
    assert set(e.queries()) == set(catalogue.queries())
