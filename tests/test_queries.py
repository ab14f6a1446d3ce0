"""Every query with an oracle equals it on the smallest tables; the flagship runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from squelch.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_oracle(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    cursor = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    assert sorted(tuple(map(plain, row)) for row in got.select(*names).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_trails_cover_all_users_and_are_thinned(spark):
    seconds = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "cast(floor(unix_micros(cast(ts as timestamp)) / 1e6) as long) as s").collect():
        seconds.setdefault(r.user_id, set()).add(r.s)
    want = {}
    for user, found in seconds.items():
        s = sorted(found)
        if len(s) > 40:
            s = [s[int(k * (len(s) - 1) / 39 + 0.5)] for k in range(40)]
        want[user] = (len(s), s[0], s[-1], sum(s))
    assert want and max(len(x) for x in seconds.values()) > 40
    assert {r.user_id: (r.points, r.first_s, r.last_s, r.sum_s) for r in catalogue.QUERIES["trails_all"](spark, SF).collect()} == want
