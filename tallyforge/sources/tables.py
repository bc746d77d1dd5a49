"""Shared-folder tables, versioned stores, JSON documents and synthetic inputs."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hadoop(spark: SparkSession, path: str):
    """The file system of a URI, and the URI as its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder (none if it is absent), sorted."""
    fs, at = hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Where the session names none, a local session gets a folder of its own; on a
    cluster this is an error, as executors would write where the driver cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        base = spark.sparkContext.getCheckpointDir()
    fs, at = hadoop(spark, f"{base.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}")
    fs.deleteOnExit(at)
    return fs.makeQualified(at).toString()  # with its scheme, so that all readers mean the same file system


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet (``codec``: of the session if none is given) into the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes tables that ``materialise`` wrote and that nothing reads any more."""
    for t in written:
        fs, at = hadoop(t.sparkSession, t._written)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


def numbered(df: DataFrame, order: list[str], out: str, name: str = "numbered") -> DataFrame:
    """Adds ``out``: gapless numbers from 0 in ``order``, over any number of rows.

    Rows are dealt by range and sorted in their partitions; each partition's count
    shifts those after it, so no task sees all rows.  The rows are written once.
    """
    part, at, count, first, off = (f"_{x}_{out}" for x in ("part", "at", "n", "first", "off"))
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = materialise(spread.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), name)
    counts = spread.groupBy(part).agg(F.count("*").alias(count), F.min(at).alias(first))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select(part, first, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(off))
    return spread.join(F.broadcast(offsets), part).withColumn(out, F.col(off) + F.col(at) - F.col(first)).drop(part, at, first, off)


class Conflict(RuntimeError):
    """Another writer changed the same keys first."""


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Writes a small file whole, and only if it is absent; False if it is there.

    The file is written aside and then takes its name in one step that fails where the
    name is taken: a hard link on a local disk, a rename elsewhere (HDFS refuses one
    onto an existing file; a store whose renames replace files is no place for this).
    """
    fs, target = hadoop(spark, f"{folder}/{name}")
    aside = hadoop(spark, f"{folder}/.aside-{uuid.uuid4().hex}")[1]
    fs.mkdirs(target.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and fs.rename(aside, target)
        nio, none = spark._jvm.java.nio.file, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)
        at = lambda p: nio.Paths.get(p.toUri().getPath(), none)
        try:
            nio.Files.createLink(at(target), at(aside))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True
    finally:
        fs.delete(aside, False)


def read_small(spark: SparkSession, path: str) -> str:
    fs, at = hadoop(spark, path)
    opened = fs.open(at)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()


class Store:
    """Records by key (catalog entries, recovery points, deployments, fences, epochs) that several writers change.

    A version is a numbered commit file, which only one writer can create, and the
    Parquet table it names: the records it put, and the keys it removed.  Readers take
    the newest record of each key up to a version, so an unfinished write is never
    seen and a reader keeps its version.  A writer whose number is taken looks at what
    came in between: other keys, and it takes the next number; the same, and it gets
    ``Conflict``.  After ``SNAPSHOT`` commits one with all records
    shortens the way.
    """

    SNAPSHOT = 16

    def __init__(self, spark: SparkSession, uri: str, schema: str, key: str):
        self.spark, self.uri, self.schema, self.key = spark, uri.rstrip("/"), schema, key

    def versions(self) -> list[int]:
        return [int(n) for n in children(self.spark, f"{self.uri}/commits") if n.isdigit()]

    def head(self) -> int:
        """The newest version (0: nothing was written yet)."""
        return max(self.versions(), default=0)

    def _commit(self, version: int) -> dict:
        return json.loads(read_small(self.spark, f"{self.uri}/commits/{version:09d}"))

    def _changes(self, version: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _gone boolean").parquet(self._commit(version)["data"]).withColumn("_version", F.lit(version))

    def load(self, version: int | None = None) -> DataFrame:
        """All records as of a version (the newest): none if nothing was written yet.  KeyError for a version that has expired."""
        at, parts = self.head() if version is None else version, []
        while at > 0:
            if not exists(self.spark, f"{self.uri}/commits/{at:09d}"):
                raise KeyError(f"version {version} of {self.uri} is not there")
            parts.append(self._changes(at))
            if self._commit(at)["snapshot"]:
                break
            at -= 1
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = reduce(DataFrame.unionByName, parts)
        newest = every.groupBy(self.key).agg(F.max("_version").alias("_version"))
        return every.join(newest, [self.key, "_version"]).where("not _gone").select(*self.spark.createDataFrame([], self.schema).columns)

    def get(self, *keys) -> DataFrame:
        """The records with these keys."""
        return self.load().where(F.col(self.key).isin(*keys))

    def _write(self, changes: DataFrame, base: int, snapshot: bool = False) -> int:
        """Commits changes that were made on version ``base``; the version they got."""
        folder = f"{self.uri}/data/{uuid.uuid4().hex}"
        changes.write.parquet(folder)
        own = self.spark.read.parquet(folder).select(self.key)
        while True:
            if publish(self.spark, f"{self.uri}/commits", f"{base + 1:09d}", json.dumps({"data": folder, "snapshot": snapshot})):
                return base + 1
            if snapshot:
                fs, at = hadoop(self.spark, folder)
                fs.delete(at, True)
                return base  # somebody wrote meanwhile; the next commit tries again
            base += 1
            if not self._commit(base)["snapshot"] and not self._changes(base).join(own, self.key, "left_semi").isEmpty():
                fs, at = hadoop(self.spark, folder)
                fs.delete(at, True)
                raise Conflict(f"version {base} of {self.uri} changed the same keys")

    def _settle(self, version: int) -> None:
        last = next((v for v in range(version, 0, -1) if self._commit(v)["snapshot"]), 0)
        if version - last >= self.SNAPSHOT:
            self._write(self.load(version).withColumn("_gone", F.lit(False)), version, snapshot=True)

    def put(self, rows: DataFrame, base: int | None = None) -> DataFrame:
        """Inserts or replaces records and reads them back.

        ``base`` is the version that the caller has read (the newest): ``Conflict`` if
        another writer has changed one of these keys since.  ValueError if what is
        stored differs or a key repeats in ``rows``.
        """
        base = self.head() if base is None else base
        rows = materialise(rows.select(*self.spark.createDataFrame([], self.schema).columns), "store-put")
        if not rows.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError(f"a {self.key} is put twice")
        version = self._write(rows.withColumn("_gone", F.lit(False)), base)
        stored = self.load(version)
        if not rows.exceptAll(stored.join(rows.select(self.key), self.key, "left_semi").select(*rows.columns)).isEmpty():
            raise ValueError("the store does not hold what was put")
        discard(rows)
        self._settle(version)
        return stored

    def delete(self, key, base: int | None = None) -> DataFrame:
        """Without this record; KeyError if it is absent."""
        base = self.head() if base is None else base
        held = self.load(base).where(F.col(self.key) == key)
        if held.isEmpty():
            raise KeyError(f"{self.key} {key} is not in the store")
        version = self._write(held.withColumn("_gone", F.lit(True)), base)
        self._settle(version)
        return self.load(version)

    def expire(self, keep: int = 1) -> list[int]:
        """Removes versions that no reader of the newest ``keep`` needs; those removed."""
        oldest = self.head() - keep + 1
        needed = max((v for v in self.versions() if v <= oldest and self._commit(v)["snapshot"]), default=0)
        gone = [v for v in self.versions() if v < needed]
        for v in gone:
            for path in (self._commit(v)["data"], f"{self.uri}/commits/{v:09d}"):
                fs, at = hadoop(self.spark, path)
                fs.delete(at, True)
        return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Catalogs, recovery points, deployment states, plans and receipts: JSON with a declared schema; unknown keys are ignored."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


# Generated trees (files, bytes each, share of hot files).
PROFILES = {
    "SMALL": (20, 4096, 0.20),
    "MEDIUM": (200, 65536, 0.15),
    "DATABASE-LIKE": (8, 1048576, 0.50),
    "MEDIA-LIKE": (50, 524288, 0.05),
    "LOG-LIKE": (5, 262144, 1.00),
}


def generate(spark: SparkSession, profile: str, seed: int = 1) -> DataFrame:
    """Objects of a profile: path, length, hot, content.  Content repeats a digest of (seed, number), so equal calls give equal bytes."""
    files, size, hot = PROFILES[profile]
    block = F.unhex(F.sha2(F.concat_ws("/", F.lit(seed), "id").cast("binary"), 256))
    return spark.range(files).select(
        F.format_string("data/file-%05d.bin", "id").alias("path"), F.lit(size).cast("long").alias("length"),
        (F.col("id") < int(files * hot)).alias("hot"), F.unhex(F.repeat(F.hex(block), size // 32)).alias("content"),
    )


# Small fixture trees (name pattern, files, bytes each; null bytes: JSON values).
FIXTURES = {
    "database": (("db-%02d.bin", 3, 262144),),
    "media": (("media/clip-%02d.bin", 8, 131072),),
    "append-log": (("logs/app-%02d.log", 3, 98304),),
    "key-value": (("kv/key-%02d.json", 40, None),),
    "generic": (("note-%02d.txt", 1, 512), ("data/blob-%02d.bin", 1, 16384)),
}


def fixture(spark: SparkSession, kind: str) -> DataFrame:
    """Objects of a fixture: path, mode, content.  The files of ``append-log`` are alike, so they deduplicate."""
    out = None
    for pattern, files, size in FIXTURES[kind]:
        number = F.lit(171).cast("int") if kind == "append-log" else F.col("id").cast("int")
        fill = F.unhex(F.repeat(F.lpad(F.hex(number), 2, "0"), size)) if size else F.encode(F.format_string('{"id":%d,"value":"v%d"}', "id", "id"), "utf-8")
        part = spark.range(files).select(F.format_string(pattern, "id").alias("path"), F.lit(0o644).alias("mode"), fill.alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def generate_log(spark: SparkSession, records: int, paths: int, seed: int = 1) -> DataFrame:
    """A deterministic change log over ``paths`` paths."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 40))
    kinds = F.array(*map(F.lit, ("write", "write", "write", "create", "delete", "truncate", "chmod", "write")))
    return spark.range(1, records + 1).select(
        F.col("id").alias("seq"), F.lit(1).cast("long").alias("epoch"), F.lit(1).cast("long").alias("fence_token"), F.lit("r").alias("resource"),
        F.element_at(kinds, (F.pmod(h, F.lit(8)) + 1).cast("int")).alias("kind"), F.format_string("p/%d", F.pmod(F.floor(h / 8), F.lit(paths))).alias("path"),
        F.lit("").alias("dest_path"), F.lit(0).cast("long").alias("offset"), F.lit(0o644).alias("mode"), F.pmod(h, F.lit(5000)).alias("size"),
        F.sha2(h.cast("string").cast("binary"), 256).alias("content_hash"), F.concat(F.lit("op-"), "id").alias("client_op_id"), F.hex(h).alias("payload"),
    )
