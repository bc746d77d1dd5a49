"""Listings of folders by Spark tasks, a round for each level of folders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import tables

#: Tasks that list folders of a level, at most.
TASKS = 1 << 12


def qualified(spark: SparkSession, root: str) -> str:
    """A folder's URI with its scheme, without a slash at its end."""
    fs, at = tables.hadoop(spark, root)
    return fs.makeQualified(at).toString().rstrip("/")


def walk(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path (relative), length, modificationTime of all files below a folder, empty ones too.

    Spark's own file sources leave out empty files.  ``hidden`` also lists what they
    hide, names that begin with "." or "_".  A folder is listed by one task; content
    is not read.
    """
    base = qualified(spark, root)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(base)
        for b in batches:
            for folder in b.column(0).to_pylist():
                below = fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/{folder}" if folder else top))
                found = [x for x in below if hidden or x.base_name[0] not in "._"]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{folder}/{x.base_name}" if folder else x.base_name for x in found], pa.string()),
                    "is_folder": pa.array([x.type == pyarrow.fs.FileType.Directory for x in found], pa.bool_()),
                    "length": pa.array([x.size for x in found], pa.int64()),
                    "modificationTime": pa.array([x.mtime for x in found], pa.timestamp("us", "UTC")),
                })

    folders, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        seen = tables.materialise(folders.mapInArrow(look, "path string, is_folder boolean, length long, modificationTime timestamp"), "listing")
        found.append(seen.where("not is_folder").drop("is_folder"))
        folders = seen.where("is_folder").select("path")
        if not (n := folders.count()):
            return reduce(DataFrame.unionByName, found)
        folders = folders.repartition(min(n, TASKS), F.col("path"))


def with_content(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Adds ``content`` to files of a ``walk``; each must fit a row."""
    base = qualified(spark, root)
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(base)
        for b in batches:
            for k, path in enumerate(b.column("path").to_pylist()):
                with fs.open_input_file(f"{top}/{path}") as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([data], pa.binary())], names=[*b.schema.names, "content"])

    return files.mapInArrow(read, schema)
