"""Stored hash trees: a manifest's digests by level, updated from changed leaves only and compared from the root down.

A node is a prefix of the SHA-256 of the path (hex digits, so 16 children each), so a
changed, new or removed path touches one leaf and its ancestors and shifts no other node.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: Entries that a leaf holds on average.
LEAF = 64
#: Up to so many nodes of a level are looked up as a list that Parquet prunes by; beyond, by a join.
LISTED = 256
NODES = "level int, parent string, node string, hash string, entries long"
ENTRIES = "leaf string, path string, hash string"


class Diff(NamedTuple):
    """``rows``: path, status (missing, extra, mismatch), active_hash, candidate_hash; ``nodes``: tree nodes that were compared."""

    rows: DataFrame
    nodes: int


def depth_for(entries: int) -> int:
    """Levels below the root at which a leaf holds about ``LEAF`` entries."""
    depth = 0
    while entries > LEAF * 16**depth:
        depth += 1
    return depth


def _few(keys: DataFrame) -> list | DataFrame:
    """The keys (one column) as a list if they are at most ``LISTED``."""
    rows = keys.limit(LISTED + 1).collect()
    return [r[0] for r in rows] if len(rows) <= LISTED else keys


def _only(df: DataFrame, column: str, keys: list | DataFrame) -> DataFrame:
    if isinstance(keys, list):
        return df.where(F.col(column).isin(keys)) if keys else df.where(F.lit(False))
    return df.join(keys.toDF(column), column, "left_semi").select(*df.columns)


def _leaves(entries: DataFrame, depth: int) -> DataFrame:
    """Nodes of the last level; leaves hold some hundred entries at most, as digests spread evenly."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: F.concat(x["path"], F.lit(":"), x["hash"], F.lit("\n")))
    made = entries.groupBy(F.col("leaf").alias("node")).agg(F.sha2(F.array_join(listed, ""), 256).alias("hash"), F.count("*").alias("entries"))
    return _as_level(made, depth)


def _as_level(nodes: DataFrame, level: int) -> DataFrame:
    parent = F.substring("node", 1, level - 1) if level else F.lit(None).cast("string")
    return nodes.select(F.lit(level).alias("level"), parent.alias("parent"), "node", "hash", "entries")


def _parents(children: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` from all children of each; children without entries count for nothing."""
    held = F.filter(F.array_sort(F.collect_list(F.struct("node", "hash", "entries"))), lambda x: x["entries"] > 0)
    lines = F.transform(held, lambda x: F.concat(x["node"], F.lit(":"), x["hash"], F.lit("\n")))
    made = children.groupBy(F.col("parent").alias("node")).agg(F.sum("entries").alias("entries"), lines.alias("_l"))
    return _as_level(made.select("node", F.when(F.col("entries") > 0, F.sha2(F.array_join("_l", ""), 256)).alias("hash"), "entries"), level)


class HashTree:
    """The tree of a manifest below ``uri``, in numbered versions.

    A version holds only the leaves and nodes that it changed; the newest row of a node
    counts.  Rows are sorted by node, so a reader that asks for few nodes reads few row
    groups.  One writer of two that make the same version wins; the other gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def head(self) -> int:
        return max((int(n) for n in tables.children(self.spark, f"{self.uri}/commits") if n.isdigit()), default=0)

    def _commit(self, version: int) -> dict:
        return json.loads(tables.read_small(self.spark, f"{self.uri}/commits/{version:09d}"))

    @property
    def depth(self) -> int:
        return self._commit(1)["depth"]

    def build(self, manifest: DataFrame, depth: int | None = None) -> HashTree:
        """The first version, from a whole manifest (path, hash; paths do not repeat, hashes are not null)."""
        depth = depth_for(manifest.count()) if depth is None else depth
        entries = manifest.select(F.substring(F.sha2("path", 256), 1, depth).alias("leaf"), "path", "hash")
        return self._write(entries, None, depth, 0)

    def update(self, changes: DataFrame) -> HashTree:
        """The next version: ``changes`` are paths with new hashes (null: the path is gone).  Reads and writes touched leaves and their ancestors only."""
        version, depth = self.head(), self.depth
        changes = tables.materialise(changes.select(F.substring(F.sha2("path", 256), 1, depth).alias("leaf"), "path", F.col("hash").alias("_new")), "tree-changes")
        touched = _few(changes.select("leaf").distinct())
        held = self._newest("entries", version, "leaf", touched)
        kept = held.join(changes.select("path"), "path", "left_anti").select("leaf", "path", "hash")
        entries = kept.unionByName(changes.where("_new is not null").select("leaf", "path", F.col("_new").alias("hash")))
        self._write(entries, changes.select(F.col("leaf").alias("node")).distinct(), depth, version)
        tables.discard(changes)
        return self

    def _write(self, entries: DataFrame, touched: DataFrame | None, depth: int, base: int) -> HashTree:
        folder = f"{self.uri}/data/{uuid.uuid4().hex}"
        entries.repartitionByRange("leaf", "path").sortWithinPartitions("leaf", "path").write.parquet(f"{folder}/entries")
        entries = self.spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
        level = _leaves(entries, depth)
        if touched is not None:  # leaves that lost their last entry stay as nodes without a hash
            empty = touched.join(level.select("node"), "node", "left_anti").select("node", F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("entries"))
            level = level.unionByName(_as_level(empty, depth))
        for at in range(depth, -1, -1):
            level.repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{folder}/nodes/{at}")
            mine = self.spark.read.schema(NODES).parquet(f"{folder}/nodes/{at}")
            if at:
                children = mine
                if base:
                    kept = self._newest(f"nodes/{at}", base, "parent", _few(mine.select("parent").distinct()))
                    children = mine.unionByName(kept.join(mine.select("node"), "node", "left_anti").select(*mine.columns))
                level = _parents(children, at - 1)
        if not tables.publish(self.spark, f"{self.uri}/commits", f"{base + 1:09d}", json.dumps({"data": folder, "depth": depth})):
            fs, at = tables.hadoop(self.spark, folder)
            fs.delete(at, True)
            raise tables.Conflict(f"version {base + 1} of {self.uri} is there already")
        return self

    def _newest(self, what: str, version: int, column: str, keys: list | DataFrame) -> DataFrame:
        """Rows of ``what`` with these keys, as of a version.

        The key of a row's group is its leaf (entries) or node; groups are written whole, so the
        newest version that wrote one has all of it.
        """
        group, schema = ("leaf", ENTRIES) if what == "entries" else ("node", NODES)
        every = []
        for v in range(1, version + 1):
            rows = self.spark.read.schema(schema).parquet(f"{self._commit(v)['data']}/{what}")
            every.append(_only(rows, column, keys).withColumn("_v", F.lit(v)))
        if len(every) == 1:
            return every[0].drop("_v")
        rows = reduce(DataFrame.unionByName, every)
        if what != "entries":
            newest = rows.groupBy(group).agg(F.max("_v").alias("_v"))
            return rows.join(newest, [group, "_v"]).select(*rows.drop("_v").columns)
        depth, written = self.depth, []  # a leaf that a version emptied has a node there but no entries
        for v in range(1, version + 1):
            nodes = self.spark.read.schema(NODES).parquet(f"{self._commit(v)['data']}/nodes/{depth}")
            written.append(_only(nodes.select(F.col("node").alias("leaf")), "leaf", keys).withColumn("_v", F.lit(v)))
        newest = reduce(DataFrame.unionByName, written).groupBy("leaf").agg(F.max("_v").alias("_v"))
        return rows.join(newest, ["leaf", "_v"]).select(*rows.drop("_v").columns)

    def entries(self, version: int | None = None) -> DataFrame:
        """path, hash of all paths as of a version."""
        version, depth = self.head() if version is None else version, self.depth
        nodes = [self.spark.read.schema(NODES).parquet(f"{self._commit(v)['data']}/nodes/{depth}").select(F.col("node").alias("leaf"), F.lit(v).alias("_v")) for v in range(1, version + 1)]
        rows = [self.spark.read.schema(ENTRIES).parquet(f"{self._commit(v)['data']}/entries").withColumn("_v", F.lit(v)) for v in range(1, version + 1)]
        newest = reduce(DataFrame.unionByName, nodes).groupBy("leaf").agg(F.max("_v").alias("_v"))
        return reduce(DataFrame.unionByName, rows).join(newest, ["leaf", "_v"]).select("path", "hash")

    def nodes(self, level: int, parents: list | DataFrame | None = None, version: int | None = None) -> DataFrame:
        """node, hash, entries of a level (of the children of these parents); nodes without entries are left out."""
        version = self.head() if version is None else version
        if parents is None:
            parts = [self.spark.read.schema(NODES).parquet(f"{self._commit(v)['data']}/nodes/{level}").withColumn("_v", F.lit(v)) for v in range(1, version + 1)]
            rows = reduce(DataFrame.unionByName, parts)
            rows = rows.join(rows.groupBy("node").agg(F.max("_v").alias("_v")), ["node", "_v"])
        else:
            rows = self._newest(f"nodes/{level}", version, "parent", parents)
        return rows.where("entries > 0").select("node", "hash", "entries")

    def root(self, version: int | None = None) -> DataFrame:
        """One row: root (null: no entries), entries."""
        return self.nodes(0, None, version).agg(F.max("hash").alias("root"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"))


def diff(active: HashTree, candidate: HashTree, active_version: int | None = None, candidate_version: int | None = None) -> Diff:
    """Paths that differ, entering only subtrees whose digests differ: k changes among n paths read about 32 k log16(n / 64) nodes.

    Two versions of one tree can be compared too.  Trees of unequal depth have no common nodes: ValueError.
    """
    if (depth := active.depth) != candidate.depth:
        raise ValueError(f"trees of depth {depth} and {candidate.depth} cannot be compared")
    sides = [(t, t.head() if v is None else v) for t, v in ((active, active_version), (candidate, candidate_version))]
    compared, keys = 1, None
    for level in range(depth + 1):
        a, c = (t.nodes(level, keys, v).select("node", F.col("hash").alias(n)) for (t, v), n in zip(sides, ("a", "c"), strict=True))
        both = tables.materialise(a.join(c, "node", "full_outer"), "tree-level")
        if level:
            compared += both.count()
        keys = _few(both.where(~F.col("a").eqNullSafe(F.col("c"))).select("node"))
        if keys == []:
            break
    a, c = (t._newest("entries", v, "leaf", keys).select("path", F.col("hash").alias(n)) for (t, v), n in zip(sides, ("active_hash", "candidate_hash"), strict=True))
    status = F.when(F.col("candidate_hash").isNull(), "missing").when(F.col("active_hash").isNull(), "extra").otherwise("mismatch")
    rows = a.join(c, "path", "full_outer").where(~F.col("active_hash").eqNullSafe(F.col("candidate_hash")))
    return Diff(rows.select("path", status.alias("status"), "active_hash", "candidate_hash"), compared)
