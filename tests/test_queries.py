"""Every registered core query against its SQL on DuckDB, over whole test tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import queries as core


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return int(v) if isinstance(v, bool) is False and hasattr(v, "as_tuple") else v


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    df = core.QUERIES[name](spark, sf_dir)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = connect(sf_dir).execute(core.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert got


def test_queries_without_sql(spark, sf_dir):
    for name in sorted(core.QUERIES.keys() - core.ORACLE_SQL.keys()):
        assert core.QUERIES[name](spark, sf_dir).count() >= 1


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "event_id", "event_type", "value"] and df.count() > 0


def test_plans_push_down_and_prune(spark, sf_dir):
    plan = core.QUERIES["lww_state"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan and "CartesianProduct" not in plan
    plan = core.QUERIES["verify_metadata"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan
