"""Every query of the engine against its SQL, as sorted rows."""

import datetime as dt
import os

import duckdb
import pytest

from lodestone import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=key)
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(Q.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
    assert {c: kinds[str(t)] for c, t in zip(want.columns, want.types)} == dict(df.dtypes)
    got = sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert rows == got


@pytest.mark.parametrize("name, nulls_first", [("order_nulls_asc", True), ("order_nulls_desc", False)])
def test_order_has_every_row_and_both_kinds(spark, name, nulls_first):
    """Cut into several sorted partitions, whatever the size of the table."""
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = sorted(Q.QUERIES[name](spark, SF).collect(), key=lambda r: r.position)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    nulls = sum(r.value is None for r in rows)
    assert [r.position for r in rows] == [*range(1, spark.read.parquet(f"{SF}/events.parquet").count() + 1)]
    assert 0 < nulls < len(rows) and all((r.value is None) == ((k < nulls) if nulls_first else (k >= len(rows) - nulls)) for k, r in enumerate(rows))
    some = [(r.value if nulls_first else -r.value, r.event_id) for r in rows if r.value is not None]
    assert some == sorted(some)
