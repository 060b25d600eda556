"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tideql import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=repr)


def test_hashes(spark):
    import hashlib
    import zlib

    for r in queries.QUERIES["fn_hash"](spark, FOLDER).limit(5).collect():
        assert (r.a, r.b) == (96, 128)
    kinds = {r.event_type for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_type").distinct().collect()}
    assert {f"{zlib.crc32(k.encode()):x}" for k in kinds} == {r.c for r in queries.QUERIES["fn_hash"](spark, FOLDER).select("c").distinct().collect()}
    assert hashlib.sha384(b"").digest_size == 48


def test_geohash(spark):
    from tideql.functions.extras import STEPS, bits, box, neighbour, number, text

    assert text(bits(57.64911, 10.40744, 55), 55) == "u4pruydqqvj"
    assert text(neighbour(number("dqcjq"), 25, STEPS["North"]), 25) == "dqcjw"
    a, b, c, d = box(number("ezs42"), 25)
    assert round((a + b) / 2, 1) == 42.6 and round((c + d) / 2, 1) == -5.6
    for r in queries.QUERIES["udf_geohash"](spark, FOLDER).limit(20).collect():
        assert r.n[:3] and abs(r.lat) <= 90 and len(r.g) == 12
