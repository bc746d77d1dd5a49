"""The queries that have SQL against DuckDB, over whole test tables and planted rows."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries


def expected(name, sf_dir):
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    return columns, sorted(map(tuple, found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("planted", [False, True])
def test_query_equals_sql(spark, sf_dir, tmp_path, name, planted):
    if planted:  # near copies of the vectors, and texts with nulls, marks, repeats and no letters
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        near = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x, i: x + F.when(i % 2 == 0, 0.01).otherwise(-0.01).cast("float") * F.abs(x)).alias("embedding"), "label")
        odd = spark.createDataFrame([(20_001, None, 1), (20_002, [0.0] * 64, 1), (20_003, [1.0] * 63 + [None], 1), (20_004, [1.0] * 64, None), (20_005, [float("nan")] * 64, 1)], e.schema)
        e.unionByName(near).unionByName(odd).write.parquet(str(tmp_path / "embeddings.parquet"))
        d = spark.read.parquet(f"{sf_dir}/documents.parquet")
        texts = [None, "", "123 !?", "a", "Ça été́ très É", "ΣΑΣ Ελληνικά", "same same same", "same same same", "x" * 5000]
        more = spark.createDataFrame([(50_000 + i, t, None if i % 2 else "zz", "s", 0) for i, t in enumerate(texts)], d.schema)
        d.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
        sf_dir = str(tmp_path)
    columns, want = expected(name, sf_dir)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want
    if planted and name == "op4_pivot_index":
        assert sum(r[columns.index("n_links")] for r in want) > 100
