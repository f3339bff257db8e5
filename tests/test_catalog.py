"""Every query of the reference's operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandline.plans import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def comparable(rows):
    clean = [tuple(None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in rows]
    return sorted(clean, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    out = catalog.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    got = comparable(tuple(r[c] for c in cols) for r in out.collect())
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = comparable(rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [x if not isinstance(x, float) else pytest.approx(x, abs=2e-5) for x in a] == list(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    assert len(out.collect()) > 0
    assert len(set(out.columns)) == len(out.columns)
