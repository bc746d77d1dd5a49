"""One handle over the library for callers that want no modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import digests
from .operators import log_ops, manifest
from .sources import log, objects, tables


class Engine:
    """Opens change logs, object trees and archives of one session."""

    def __init__(self, spark: SparkSession, skip_prefixes: tuple[str, ...] = ()):
        self.spark, self.skip = spark, skip_prefixes

    def log(self, path: str, from_seq: int = 0, to_seq: int | None = None, strict: bool = True) -> DataFrame:
        return log.scan(self.spark, path, from_seq, to_seq, strict)

    def state(self, path: str) -> DataFrame:
        return log_ops.replay(self.log(path))

    def tree(self, root: str) -> DataFrame:
        return objects.tree(self.spark, root, self.skip)

    def checkpoint(self, root: str) -> DataFrame:
        m = manifest.manifest(self.tree(root))
        return digests.root_digest(m).crossJoin(manifest.totals(m))  # one row each

    def verify(self, active_root: str, candidate_root: str, level: str = "CHECKSUM", app_ok=None) -> DataFrame:
        return manifest.verify(manifest.manifest(self.tree(active_root)), manifest.manifest(self.tree(candidate_root)), level, app_ok)

    def export(self, root: str, uri: str, archive_id: str, epoch: int) -> dict[str, DataFrame]:
        from pyspark.sql import functions as F

        return objects.export(self.tree(root).withColumn("mode", F.lit(0o644)), uri, archive_id, epoch)

    def restore(self, uri: str) -> DataFrame:
        """Objects with content, or with an error where a chunk is absent or damaged."""
        return objects.restore(objects.inspect(self.spark, uri))

    def drill(self, uri: str) -> DataFrame:
        return objects.drill(objects.inspect(self.spark, uri))

    def store(self, uri: str, schema: str, key: str) -> tables.Store:
        """Catalog entries, recovery points, deployments, fences or epochs (see ``schema``)."""
        return tables.Store(self.spark, uri, schema, key)

    def sink(self, uri: str, schema: str, fence: int = 0) -> log_ops.LogSink:
        return log_ops.LogSink(self.spark, uri, schema, fence)

    def shared_dir(self, name: str) -> str:
        return tables.shared_dir(self.spark, name)
