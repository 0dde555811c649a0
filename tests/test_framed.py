"""Queries from frames on, over events whose numbers look like something else or outgrow a byte, against their SQL."""

import datetime

import pytest

duckdb = pytest.importorskip("duckdb")
from packetloom.plans import catalog, framed  # noqa: E402, F401  framed adds its queries

KINDS = ["click", "view", "error", "signup", "purchase"]
#: DNS ids 0x1603 (a TLS record), client ports 8000, 8080 and 8443 (other protocols)
CYCLE = 122_880_000  # of ids and ports
NUMBERS = [5, 5635, 6976, 7056, 7419, 65536 + 5635]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def made(name, users):
        rows = []
        for i, number in enumerate([*NUMBERS, *range(100, 130)]):
            for j, kind in enumerate(KINDS):
                for n, k in enumerate((7, 43, 45, 60)):
                    rows.append((number + CYCLE * (4 * j + n), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), users[(i + j + k) % len(users)], kind, 1.5, f'{{"k": {k}}}'))
        path = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet')")
        return str(path), con

    return {"few": made("few", [5, 6, 255, 256]), "many": made("many", [5, 255, 65535, 65536 + 5, 70000, 89999, (1 << 24) + 5, 1 << 31])}


@pytest.mark.parametrize("users", ["few", "many"])
@pytest.mark.parametrize("name", ["decode_frames", "decode_messages", "engine_signatures", "handshake_outcomes", "dns_transactions"])
def test_framed(spark, tables, name, users):
    path, con = tables[users]
    got = catalog.QUERIES[name](spark, path)
    want = con.execute(catalog.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))
