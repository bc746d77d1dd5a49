"""Bytes that archives move: each content once as it is, never twice or as text."""

from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.sources import objects, tables


def _noise(spark, n=40, blocks=64):
    """Binary objects of 2 KB that no codec shortens."""
    parts = [F.unhex(F.sha2(F.concat_ws("/", "id", F.lit(i)).cast("binary"), 256)) for i in range(blocks)]
    return spark.range(n).select(F.format_string("%06d.bin", "id").alias("path"), F.lit(420).alias("mode"), F.concat(F.lit(b"\0"), *parts).alias("content"))


def _written(spark, path):
    fs, at = tables.hadoop(spark, path)
    return fs.getContentSummary(at).getLength()


def test_sanitised_clone_writes_each_content_once(spark, tmp_path, monkeypatch):
    seen, plain = {}, tables.materialise

    def sized(df, name, *rest):
        out = plain(df, name, *rest)
        seen[name] = _written(spark, out._written)
        return out

    objs = _noise(spark)
    archive = objects.export(objs, f"{tmp_path}/a", "a", 1, 512)
    monkeypatch.setattr(tables, "materialise", sized)
    made = objects.sanitised_clone(archive, f"{tmp_path}/b", "b", [text.redact_emails], 512)
    assert made["summary"].first()["changed_objects"] == 0
    assert seen["sanitised"] < 1.5 * 40 * 2048


def test_restore_joins_chunks_as_bytes(spark, tmp_path):
    objs = _noise(spark)
    archive = objects.export(objs, f"{tmp_path}/a", "a", 1, 100)
    back = objects.restore(archive)
    assert "hex(" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert not back.select("path", "mode", "content").exceptAll(objs).count() and back.where("error is null").count() == 40


def test_archives_are_stored_packed(spark, tmp_path):
    """Hex digests take half their letters, and text less than with Spark's default."""
    docs = tables.table(spark, "/root/testdata/sf0.001", "documents")
    objects.export(objects.as_objects(docs), f"{tmp_path}/a", "a", 1, 1024)
    spark.read.parquet(f"{tmp_path}/a/chunks").write.parquet(f"{tmp_path}/default")
    assert _written(spark, f"{tmp_path}/a/chunks") < 0.8 * _written(spark, f"{tmp_path}/default")
