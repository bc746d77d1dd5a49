"""Digests over ordered collections; equal to hashing the concatenated bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def ordered_text(line: Column, order: Column) -> Column:
    """Aggregate: the lines in order, each as it is; '' for none.  For groups that fit one row (up to about 10 ** 6 lines)."""
    sorted_lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.array_join(F.transform(sorted_lines, lambda x: x["l"]), "")


#: Bytes of lines that travel as one row.
PIECE = 4 << 20


def ordered_sha256(rows: DataFrame, line: Column, order: str, out: str = "root") -> DataFrame:
    """One row: SHA-256 of all lines in order, for any number of rows.

    Lines are sorted in parallel by range and joined into pieces of about ``PIECE``
    bytes.  The digest itself is one sequence by definition: one task reads the
    pieces in order, holding one batch at a time.
    """
    spread = rows.select(F.col(order).alias("o"), line.alias("l")).repartitionByRange("o").sortWithinPartitions("o")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for x in b.column(1).cast(pa.binary()).to_pylist():
                held.append(x)
                size += len(x)
                if size >= PIECE:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "data": pa.array([b"".join(held)], pa.binary())})
                    k, held, size = k + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "data": pa.array([b"".join(held)], pa.binary())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for b in batches:
            for x in b.column("data"):
                h.update(x.as_buffer())
        yield pa.RecordBatch.from_pydict({out: pa.array([h.hexdigest()])})

    pieces = tables.materialise(spread.mapInArrow(join, "part int, k int, data binary"), "digest-pieces")
    one = pieces.repartition(1).sortWithinPartitions("part", "k").mapInArrow(digest, f"{out} string")
    return tables.materialise(one.agg(F.coalesce(F.max(out), F.lit(EMPTY)).alias(out)), "digest")  # no rows: the digest of no bytes


def root_digest(manifest: DataFrame, path: str = "path", value: str = "hash", by: list[str] | None = None) -> DataFrame:
    """Flat root: SHA-256 of path-ordered ``path:hash`` lines; per group of ``by``, whose groups must fit a row each."""
    line = F.concat(F.col(path), F.lit(":"), F.col(value), F.lit("\n"))
    if not by:
        return ordered_sha256(manifest, line, path)
    return manifest.groupBy(*by).agg(F.sha2(ordered_text(line, F.col(path)), 256).alias("root"))


def archive_root(objects: DataFrame) -> DataFrame:
    """SHA-256 of path-ordered ``path:hash:size`` lines."""
    return ordered_sha256(objects, F.concat(F.col("path"), F.lit(":"), F.col("content_hash"), F.lit(":"), F.col("size").cast("string"), F.lit("\n")), "path")


def flat_digest(manifest: DataFrame) -> DataFrame:
    """(digest, root): SHA-256 of ``path NUL hash NUL`` in path order, and SHA-256 of that digest's hex."""
    line = F.concat(F.col("path"), F.lit("\0"), F.col("hash"), F.lit("\0"))
    return ordered_sha256(manifest, line, "path", "digest").withColumn("root", F.sha2("digest", 256))


def bucketed_root(manifest: DataFrame, buckets: int = 1024) -> DataFrame:
    """A root that is computed in parallel: flat roots of path-hash buckets, then the root over buckets.  Its value is its own, not ``root_digest``'s."""
    per = root_digest(manifest.withColumn("bucket", F.lpad(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("string"), 6, "0")), by=["bucket"])
    return root_digest(per, "bucket", "root")


def merkle_root(manifest: DataFrame) -> str:
    """Pairwise tree over path-ordered ``path:hash`` leaves: raw digests are concatenated, an odd node moves up unchanged.

    The leaves are numbered once; each of the log2(n) levels halves the rows.
    """
    leaf = F.sha2(F.concat("path", F.lit(":"), "hash"), 256)
    nodes = tables.numbered(manifest.select("path", leaf.alias("h")), ["path"], "i", "merkle-leaves").select("i", "h")
    n = nodes.count()
    if not n:
        return EMPTY
    while n > 1:
        pair = F.array_sort(F.collect_list(F.struct("i", "h")))
        nodes = (
            nodes.groupBy(F.floor(F.col("i") / 2).alias("j")).agg(pair.alias("p"))
            .select(F.col("j").alias("i"), F.when(F.size("p") == 2, F.sha2(F.concat(F.unhex(F.col("p")[0]["h"]), F.unhex(F.element_at("p", 2)["h"])), 256)).otherwise(F.col("p")[0]["h"]).alias("h"))
        )
        n = (n + 1) // 2
        if n.bit_length() % 6 == 0:
            nodes = tables.materialise(nodes, "merkle-level")
    return nodes.first()["h"]


def seal(df: DataFrame, column: str = "evidence_hash") -> DataFrame:
    """Adds the SHA-256 of the row's canonical JSON (columns by name, without ``column``)."""
    names = sorted(c for c in df.columns if c != column)
    return df.withColumn(column, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))


def sealed_ok(df: DataFrame, column: str = "evidence_hash") -> DataFrame:
    """Adds ``seal_ok``: whether the stored seal is the recomputed one."""
    names = sorted(c for c in df.columns if c != column)
    again = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    return df.withColumn("seal_ok", F.coalesce(again == F.col(column), F.lit(False)))
