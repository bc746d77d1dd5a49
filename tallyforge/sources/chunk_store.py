"""A chunk store that many archives share.

Each archive is an object index; its chunks stand once in the store, whichever archive
brought them.  An export looks digests up before it touches data and writes new chunks
only.  Removing an archive removes its index; ``sweep`` then finds chunks that no
index names any more (mark and sweep over the live indexes) and rewrites the segments
that hold some; ``vacuum`` deletes folders that no version names.

The state is a chain of numbered commits, each created by one writer alone.  A writer
whose number is taken looks at the state that is there now and makes good what it lacks,
so an export that counted on a chunk which a sweep dropped meanwhile writes it again.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import objects, tables

CHUNKS = "hash string, length int, data binary"
INDEX = "path string, mode int, size long, chunk_ids array<string>, content_hash string"


class ChunkStore:
    def __init__(self, spark: SparkSession, uri: str, size: int = objects.BLOCK):
        fs, at = tables.hadoop(spark, uri)
        self.spark, self.uri, self.size = spark, fs.makeQualified(at).toString().rstrip("/"), size

    def state(self) -> tuple[int, dict]:
        """The newest version and what it holds: ``archives`` (id: folder of its index) and ``segments`` (folders of chunks)."""
        version = max((int(n) for n in tables.children(self.spark, f"{self.uri}/commits") if n.isdigit()), default=0)
        held = json.loads(tables.read_small(self.spark, f"{self.uri}/commits/{version:09d}")) if version else {"archives": {}, "segments": []}
        return version, held

    def _publish(self, base: int, held: dict) -> bool:
        return tables.publish(self.spark, f"{self.uri}/commits", f"{base + 1:09d}", json.dumps(held, sort_keys=True))

    def _folder(self, kind: str) -> str:
        return f"{self.uri}/{kind}/{uuid.uuid4().hex}"

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _chunks(self, held: dict) -> DataFrame:
        return self._read(held["segments"], CHUNKS)

    def _indexes(self, held: dict) -> DataFrame:
        return self._read(sorted(held["archives"].values()), INDEX)

    def export(self, objs: DataFrame, archive_id: str) -> DataFrame:
        """Adds an archive of objects (path, mode, content; paths do not repeat).  One row: logical_bytes, blocks, chunks (distinct), new_chunks, new_bytes.

        ValueError if the archive exists.  Only digests are joined with the store's; data
        is read again for the chunks that are new.
        """
        if archive_id in self.state()[1]["archives"]:
            raise ValueError(f"archive {archive_id} is in the store")
        index, own = self._folder("indexes"), []
        cut = objects.blocks(objs, self.size, keep_data=True)
        listed = tables.materialise(cut.drop("data"), "store-blocks")
        objects.object_index(objs, listed).write.parquet(index)
        wanted = listed.select("hash").distinct()
        while True:
            version, held = self.state()
            if archive_id in held["archives"]:
                raise ValueError(f"archive {archive_id} is in the store")
            absent = tables.materialise(wanted.join(self._read(held["segments"] + own, CHUNKS).select("hash"), "hash", "left_anti"), "store-absent")
            if not absent.isEmpty():
                fresh = cut.select("hash", "length", "data").join(absent, "hash", "left_semi").dropDuplicates(["hash"])
                own.append(self._folder("segments"))
                fresh.sortWithinPartitions("hash").write.parquet(own[-1])
            tables.discard(absent)
            if self._publish(version, {"archives": held["archives"] | {archive_id: index}, "segments": held["segments"] + own}):
                break
        new = self._read(own, CHUNKS).select("hash", "length").agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("new_bytes"))
        all_of = listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("logical_bytes"), F.count("*").alias("blocks"), F.count_distinct("hash").alias("chunks"))
        out = tables.materialise(all_of.crossJoin(new), "store-export")  # one row each
        tables.discard(listed)
        return out

    def archive(self, archive_id: str) -> dict[str, DataFrame]:
        """The ``objects`` and ``chunks`` of an archive, as ``objects.restore`` takes them; KeyError if it is not in the store."""
        held = self.state()[1]
        index = self._read([held["archives"][archive_id]], INDEX)
        wanted = index.select(F.explode("chunk_ids").alias("hash")).distinct()
        # writers that ran side by side may both have brought a chunk
        return {"objects": index, "chunks": self._chunks(held).join(wanted, "hash", "left_semi").dropDuplicates(["hash"]).select("hash", "length", "data")}

    def references(self) -> DataFrame:
        """hash, length, archives, uses (blocks) of every stored chunk; 0 where no archive names it."""
        held = self.state()[1]
        parts = [self._read([folder], INDEX).select(F.lit(a).alias("archive"), F.explode("chunk_ids").alias("hash")) for a, folder in sorted(held["archives"].items())]
        stored = self._chunks(held).select("hash", "length").distinct()
        if not parts:
            return stored.select("hash", "length", F.lit(0).cast("long").alias("archives"), F.lit(0).cast("long").alias("uses"))
        named = parts[0]
        for p in parts[1:]:
            named = named.unionByName(p)
        named = named.groupBy("hash", "archive").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("archives"), F.sum("n").alias("uses"))
        return stored.join(named, "hash", "left").select("hash", "length", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("archives", "uses")])

    def remove(self, archive_id: str) -> None:
        """Takes an archive out; its chunks stay until a sweep.  KeyError if it is not in the store."""
        while True:
            version, held = self.state()
            if archive_id not in held["archives"]:
                raise KeyError(f"archive {archive_id} is not in the store")
            if self._publish(version, held | {"archives": {a: f for a, f in held["archives"].items() if a != archive_id}}):
                return

    def sweep(self) -> DataFrame:
        """Drops chunks that no archive names.  One row: segments (rewritten), removed (chunk rows), removed_bytes.

        Segments without such chunks are not touched.
        """
        while True:
            version, held = self.state()
            live = tables.materialise(self._indexes(held).select(F.explode("chunk_ids").alias("hash")).distinct(), "store-live")
            digests = self._chunks(held).select("hash", "length", F.regexp_extract(F.col("_metadata.file_path"), r"/segments/([0-9a-f]{32})/", 1).alias("segment")) if held["segments"] else None
            found = [] if digests is None else digests.join(live, "hash", "left_anti").groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect()  # a row a segment
            dirty = {r["segment"] for r in found}
            stays = [s for s in held["segments"] if s.rsplit("/", 1)[-1] not in dirty]
            mended = []
            if dirty:
                mended.append(self._folder("segments"))
                kept = self._read([s for s in held["segments"] if s not in stays], CHUNKS).join(live, "hash", "left_semi").dropDuplicates(["hash"])
                kept.select("hash", "length", "data").sortWithinPartitions("hash").write.parquet(mended[0])
            tables.discard(live)
            if not dirty or self._publish(version, held | {"segments": stays + mended}):
                row = (len(dirty), sum(r["n"] for r in found), sum(r["bytes"] for r in found))
                return self.spark.createDataFrame([row], "segments int, removed long, removed_bytes long")

    def vacuum(self, older_than: float = 86400.0) -> list[str]:
        """Deletes folders of chunks and indexes that the newest version does not name and that nobody wrote to for ``older_than`` seconds.

        The age spares exports under way, whose folders no version names yet, and readers of earlier versions.
        """
        held, gone = self.state()[1], []
        named = {f.rsplit("/", 1)[-1] for f in [*held["segments"], *held["archives"].values()]}
        for kind in ("segments", "indexes"):
            for name in tables.children(self.spark, f"{self.uri}/{kind}"):
                fs, at = tables.hadoop(self.spark, f"{self.uri}/{kind}/{name}")
                newest = max([fs.getFileStatus(at).getModificationTime(), *[x.getModificationTime() for x in fs.listStatus(at)]])
                if name not in named and newest <= (time.time() - older_than) * 1000:
                    fs.delete(at, True)
                    gone.append(f"{kind}/{name}")
        return gone
