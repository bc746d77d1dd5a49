"""Streaming twins of the log operators; every query is restartable from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import tables


def read(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files below ``path`` (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if not path.endswith(".parquet") else f"{path}*")


def latest(stream: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Newest record per key (complete or update mode); deletes stay as records so that late writes do not revive keys."""
    newest = F.max(F.struct(F.col(seq), *[F.col(c) for c in columns])).alias("_n")
    return stream.groupBy(key).agg(newest).select(key, f"_n.{seq}", *[f"_n.{c}" for c in columns])


def heat(stream: DataFrame, key: str, at: str, seq: str, size: str) -> DataFrame:
    """Hits, bytes and the time of the last record by ``seq``, which need not be the largest time."""
    return stream.groupBy(key).agg(F.count("*").alias("hits"), F.sum(size).alias("bytes"), F.max_by(at, seq).alias("last_at"))


def first_of_op(stream: DataFrame, op: str, at: str, horizon: str) -> DataFrame:
    """First record per op id within the horizon; ids are forgotten once the watermark has passed it."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([op])


def windows(stream: DataFrame, at: str, width: str, by: list[str], value: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums per window (tumbling, or sliding by ``slide``) and group; records later than ``late`` are left out by the watermark."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return _of_window(stream.withWatermark(at, late).groupBy(window.alias("window"), *by), by, value)


def sessions(stream: DataFrame, at: str, gap: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Counts and sums per session: a session of a group ends once ``gap`` passes without a record."""
    return _of_window(stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("window"), *by), by, value)


def _of_window(grouped, by: list[str], value: str) -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def held_conditions(stream: DataFrame, by: list[str], conditions: dict) -> DataFrame:
    """How often each condition has held so far per group (complete or update mode): what the bounded tuning knobs follow from, and ``samples``, the history's length."""
    return stream.groupBy(*by).agg(F.count("*").alias("samples"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


class Progress(StreamingQueryListener):
    """Calls back after each batch with (number, rows read); add it with ``spark.streams.addListener``."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession, rocksdb: bool) -> Iterator[None]:
    """Queries that start inside use RocksDB; a query keeps the settings it started with."""
    name, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if rocksdb:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def run_to_table(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None] | None = None, folder: str | None = None, every: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Runs over all that is there (``availableNow``) and returns the written result.

    ``folder`` holds the checkpoint and a subfolder a batch.  A later call with the
    same folder resumes: it reads only what came since, and its result is that of
    all calls together.  Without one the call has a folder of its own.  A repeated
    batch overwrites its own output.  Complete mode keeps the result of the last
    batch; append mode all of them.  ``every`` polls at that interval instead and
    stops once a poll finds nothing new.  ``rocksdb`` chooses that state store for
    this query, which operators with state of their own need.
    """
    spark = stream.sparkSession
    base = (folder or tables.shared_dir(spark, "stream")).rstrip("/")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number:09d}")
        if sink:
            sink(batch, number)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep)
    with _state_store(spark, rocksdb):
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if every:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    names = [n for n in tables.children(spark, f"{base}/out") if tables.exists(spark, f"{base}/out/{n}/_SUCCESS")]
    if not names:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/{n}" for n in (names[-1:] if mode == "complete" else names)])
