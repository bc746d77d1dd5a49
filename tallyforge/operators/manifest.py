"""Manifests: totals, diff, equality and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests, rules


def manifest(objects: DataFrame) -> DataFrame:
    """path, hash, size of objects with content."""
    return objects.select("path", digests.content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def totals(objects: DataFrame, size: str = "size") -> DataFrame:
    return objects.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def diff(active: DataFrame, candidate: DataFrame) -> DataFrame:
    """path, status (same, missing, extra, mismatch), both hashes: a full outer join on path."""
    a, c = active.select("path", F.col("hash").alias("active_hash")), candidate.select("path", F.col("hash").alias("candidate_hash"))
    status = (
        F.when(F.col("candidate_hash").isNull(), "missing").when(F.col("active_hash").isNull(), "extra")
        .when(F.col("active_hash") != F.col("candidate_hash"), "mismatch").otherwise("same")
    )
    return a.join(c, "path", "full_outer").select("path", status.alias("status"), "active_hash", "candidate_hash")


def equal(active: DataFrame, candidate: DataFrame, tree: bool = False) -> DataFrame:
    """One row: whether roots (flat, or with ``tree`` of the pairwise tree), counts and bytes are equal."""

    def one(m: DataFrame, n: str) -> DataFrame:
        row = totals(m).withColumn("root", F.lit(digests.merkle_root(m))) if tree else digests.root_digest(m).crossJoin(totals(m))  # one row each
        return row.select(*[F.col(c).alias(f"{n}_{c}") for c in ("root", "files", "bytes")])

    both = one(active, "active").crossJoin(one(candidate, "candidate"))
    return both.withColumn("equal", (F.col("active_root") == F.col("candidate_root")) & (F.col("active_files") == F.col("candidate_files")) & (F.col("active_bytes") == F.col("candidate_bytes")))


def verify(active: DataFrame, candidate: DataFrame, level: str = "CHECKSUM", app_ok: Column | None = None) -> DataFrame:
    """One row: counts by status and the outcome.  METADATA reads no hashes (manifests may lack them)."""
    app = F.lit(None).cast("boolean") if app_ok is None else app_ok
    a, c = totals(active).select(F.col("files").alias("active_files"), F.col("bytes").alias("active_bytes")), totals(candidate).select(F.col("files").alias("candidate_files"), F.col("bytes").alias("candidate_bytes"))
    counted = F.lit(0).cast("long")
    if level == "METADATA":
        row = a.crossJoin(c).select("*", *[counted.alias(n) for n in ("missing", "extra", "mismatch")])
    else:
        by = diff(active, candidate).agg(*[F.count_if(F.col("status") == n).alias(n) for n in ("missing", "extra", "mismatch")])
        row = a.crossJoin(c).crossJoin(by)
    outcome = rules.verify_outcome(
        F.lit(level), F.lit(True), F.col("active_files") == F.col("candidate_files"), F.col("active_bytes") == F.col("candidate_bytes"),
        F.col("mismatch"), F.col("missing"), F.col("extra"), F.col("active_files"), app,
    )
    return row.withColumn("outcome", outcome)
