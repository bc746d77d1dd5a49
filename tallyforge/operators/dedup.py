"""Block and chunk comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_blocks(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source blocks that the target lacks or holds differently."""
    t = target.select("path", "offset", F.col("hash").alias("_h"))
    return source.join(t, ["path", "offset"], "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("hash"))).drop("_h")


def extra_blocks(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target blocks beyond the source: removed objects and shortened tails."""
    return target.join(source.select("path", "offset"), ["path", "offset"], "left_anti")


def transfer(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target after it took the changed blocks and lost the extra ones."""
    changed = changed_blocks(source, target)
    stays = target.join(changed.select("path", "offset"), ["path", "offset"], "left_anti").join(source.select("path", "offset"), ["path", "offset"], "left_semi")
    return stays.unionByName(changed)


def first_chunks(blocks: DataFrame) -> DataFrame:
    """hash, length, data of each distinct block."""
    return blocks.groupBy("hash").agg(F.first("length").alias("length"), F.first("data").alias("data"))


def stats(blocks: DataFrame, log_bytes: int = 0) -> DataFrame:
    """One row: logical bytes, physical bytes (each chunk once, plus a log copy), saved bytes, block and chunk counts."""
    per = blocks.groupBy("hash").agg(F.count("*").alias("n"), F.max("length").cast("long").alias("length"))
    return per.agg(
        F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).alias("logical_bytes"), (F.coalesce(F.sum("length"), F.lit(0)) + log_bytes).alias("physical_bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"), F.count("*").alias("chunks"),
    ).withColumn("saved_bytes", F.greatest(F.lit(0).cast("long"), F.col("logical_bytes") - F.col("physical_bytes")))


def chunk_faults(stored_digests: DataFrame, chunks: DataFrame) -> DataFrame:
    """hash, fault (missing, mismatch): listed digests whose chunk is absent or whose bytes hash otherwise."""
    actual = chunks.select("hash", F.sha2("data", 256).alias("_actual"))
    return stored_digests.select("hash").distinct().join(actual, "hash", "left").select(
        "hash", F.when(F.col("_actual").isNull(), "missing").when(F.col("_actual") != F.col("hash"), "mismatch").alias("fault"),
    ).where("fault is not null")


def reference_faults(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, fault: objects whose content hash is not that of their chunk ids, or that name an absent chunk."""
    wrong = objects.where(F.sha2(F.encode(F.array_join("chunk_ids", ""), "utf-8"), 256) != F.col("content_hash")).select("path", F.lit("content_hash").alias("fault"))
    absent = objects.select("path", F.explode("chunk_ids").alias("hash")).join(chunks.select("hash"), "hash", "left_anti").select("path", F.lit("missing_chunk").alias("fault")).distinct()
    return wrong.unionByName(absent)


def copy_missing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source rows whose path the target lacks; content is not compared."""
    return source.join(target.select("path"), "path", "left_anti")
