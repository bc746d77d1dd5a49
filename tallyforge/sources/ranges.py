"""Blocks of files of any size: a task reads a range of a file, one block at a time.

The listing reads no content.  Files are cut into ranges of whole
blocks, ranges are spread over tasks, and a task holds the blocks of one batch, so
neither the size of a file nor the number of files bounds what can be scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import listing, objects, tables

#: Bytes of a file that a task takes at least, if it has as many.
SPAN = 64 << 20
#: Tasks of a scan at most; beyond, a task takes several ranges one after another.
TASKS = 1 << 15
#: Bytes of blocks that travel in one batch.
BATCH = 4 << 20
SCHEMA = "path string, offset long, length int, hash string"


def files(spark: SparkSession, root: str, skip_prefixes: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """path (relative), size of all files below a folder, empty ones too; content is not read."""
    rows = listing.walk(spark, root, hidden)
    for p in skip_prefixes:
        rows = rows.where(~F.col("path").startswith(p))
    return rows.select("path", F.col("length").alias("size"))


def cut(listed: DataFrame, size: int = objects.BLOCK, span: int = SPAN) -> DataFrame:
    """path, start, stop: ranges of whole blocks; an empty file has none."""
    span = max(size, span // size * size)
    n = F.ceil(F.col("size") / span)
    rows = listed.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return rows.select("path", (F.col("k") * span).alias("start"), F.least((F.col("k") + 1) * span, F.col("size")).alias("stop"))


def blocks(spark: SparkSession, root: str, size: int = objects.BLOCK, keep_data: bool = False, skip_prefixes: tuple[str, ...] = (), hidden: bool = False, span: int = SPAN) -> DataFrame:
    """path, offset, length, hash (and data) of all blocks of the files below a folder, as ``objects.blocks`` gives them for contents that fit a row.

    A file that is shorter than the listing said fails the scan: it changed meanwhile.
    """
    ranges = tables.materialise(cut(files(spark, root, skip_prefixes, hidden), size, span), "ranges")
    tasks = max(1, min(ranges.count(), TASKS))
    ranges = ranges.repartition(tasks, "path", "start")  # small rows by a given number, which Spark does not merge into few tasks

    base = listing.qualified(spark, root)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, offset, data = zip(*rows, strict=True)
        made = {"path": path, "offset": pa.array(offset, pa.int64()), "length": pa.array([len(d) for d in data], pa.int32()), "hash": [hashlib.sha256(d).hexdigest() for d in data]}
        return pa.RecordBatch.from_pydict(made | ({"data": pa.array(data, pa.binary())} if keep_data else {}))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(base)
        for b in batches:
            for r in b.to_pylist():
                held = []
                with fs.open_input_file(f"{top}/{r['path']}") as f:
                    f.seek(r["start"])
                    for offset in range(r["start"], r["stop"], size):
                        data = f.read(min(size, r["stop"] - offset))
                        if len(data) != min(size, r["stop"] - offset):
                            raise OSError(f"{r['path']} is shorter than {r['stop']} bytes now")
                        held.append((r["path"], offset, data))
                        if len(held) * size >= BATCH:
                            yield batch(held)
                            held = []
                if held:
                    yield batch(held)

    return ranges.mapInArrow(read, SCHEMA + (", data binary" if keep_data else ""))


def index(spark: SparkSession, root: str, size: int = objects.BLOCK, skip_prefixes: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """``objects.object_index`` of the files below a folder, for files of any size; mode is 0644."""
    listed = files(spark, root, skip_prefixes, hidden).select("path", F.lit(0o644).alias("mode"))
    return objects.object_index(listed, blocks(spark, root, size, skip_prefixes=skip_prefixes, hidden=hidden))
