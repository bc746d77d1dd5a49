"""Change logs in segments with a sparse index of sequence numbers.

Each append writes its records sorted by range of seq, a file a segment, and then one
index row a segment: smallest and largest seq, records, bytes and a digest of the
lines.  A scan of a range reads the index and opens the segments that overlap it, so
its work grows with the range and not with the log.  Damage elsewhere is found by
``check``, which is a call of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log, tables

INDEX = "batch int, file string, min_seq long, max_seq long, records long, bytes long, digest long"


class SegmentedLog:
    """A log below ``uri``.  An append becomes visible with its index and a repeated one replaces itself, so a lost driver or executor leaves no half of it."""

    def __init__(self, spark: SparkSession, uri: str, segment_records: int = 1_000_000):
        fs, at = tables.hadoop(spark, uri)
        self.spark, self.uri, self.segment_records = spark, fs.makeQualified(at).toString().rstrip("/"), segment_records

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.uri}/{kind}/batch={batch:09d}"

    def batches(self) -> list[int]:
        names = [n for n in tables.children(self.spark, f"{self.uri}/index") if n.startswith("batch=")]
        return [int(n.split("=")[1]) for n in names if tables.exists(self.spark, f"{self.uri}/index/{n}/_SUCCESS")]

    def index(self) -> DataFrame:
        """One row a segment; none before the first append."""
        found = [self._folder("index", b) for b in self.batches()]
        return self.spark.read.schema(INDEX).parquet(*found) if found else self.spark.createDataFrame([], INDEX)

    def _lines(self, files: list[str]) -> DataFrame:
        return self.spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))

    def _summary(self, lines: DataFrame) -> DataFrame:
        """What the index says of each file: order of lines does not matter to the digest."""
        rows = log.parse(lines)
        return rows.groupBy("file").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("records"), F.max("bytes").alias("bytes"), F.bit_xor(F.xxhash64("raw")).alias("digest"))

    def append(self, records: DataFrame, batch: int) -> None:
        """Writes MUTATION columns that ``records`` has, in segments of about ``segment_records``; an empty append leaves an empty index."""
        old = tables.hadoop(self.spark, self._folder("index", batch))
        old[0].delete(old[1], True)  # until the new index is there, the batch is not
        n = max(1, -(-records.count() // self.segment_records))
        rows = records.repartitionByRange(n, "seq").sortWithinPartitions("seq")
        log.write(rows, self._folder("data", batch), "overwrite")
        names = [x for x in tables.children(self.spark, self._folder("data", batch)) if x.startswith("part-")]
        lines = self._lines([f"{self._folder('data', batch)}/{x}" for x in names])
        self._summary(lines).select(F.lit(batch).alias("batch"), "file", "min_seq", "max_seq", "records", "bytes", "digest").write.mode("overwrite").parquet(self._folder("index", batch))

    def files(self, from_seq: int = 0, to_seq: int | None = None) -> list[str]:
        """The segments that overlap a range, by the index alone."""
        rows = self.index().where(F.col("max_seq") >= from_seq)
        rows = rows if to_seq is None else rows.where(F.col("min_seq") <= to_seq)
        return sorted(r.file for r in rows.select("file").collect())

    def scan(self, from_seq: int = 0, to_seq: int | None = None) -> DataFrame:
        """Records with from_seq <= seq (<= to_seq).  A damaged line in an opened segment fails the scan; other segments are not opened."""
        found = self.files(from_seq, to_seq)
        if not found:
            return log.parse(self.spark.createDataFrame([], "value string"))
        return log.in_range(log.parse(self.spark.read.text(found)), from_seq, to_seq, True)

    def check(self) -> DataFrame:
        """Each segment of the index with ``missing`` (its file is gone), ``damaged`` (bad lines) and ``ok`` (as the index says, and whole)."""
        held = [f"{self._folder('data', b)}/{x}" for b in self.batches() for x in tables.children(self.spark, self._folder("data", b)) if x.startswith("part-")]
        lines = self._lines(held) if held else self.spark.createDataFrame([], "value string, file string, bytes long")
        bad = log.parse(lines).groupBy("file").agg(F.count_if(~(F.col("crc_ok") & F.col("parse_ok") & F.col("checksum_ok"))).alias("damaged"))
        now = self._summary(lines).join(bad, "file").select("file", "damaged", F.struct("min_seq", "max_seq", "records", "bytes", "digest").alias("_now"))
        out = self.index().join(now, "file", "left").withColumn("missing", F.col("_now").isNull())
        same = F.col("_now") == F.struct("min_seq", "max_seq", "records", "bytes", "digest")
        return out.withColumn("damaged", F.coalesce("damaged", F.lit(0))).withColumn("ok", F.coalesce(same & (F.col("damaged") == 0), F.lit(False))).drop("_now")
