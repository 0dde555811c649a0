"""Every catalog query against its DuckDB SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from packetloom.plans import catalog, framed  # noqa: E402, F401  framed adds its queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return sorted(map(repr, pdf.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        want = db.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
