"""Object trees, block indexes and content-addressed archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import listing, tables

BLOCK = 64 * 1024
FORMAT_VERSION = 1
#: Parquet codec of archives and of restored content: bytes and hex digests take a third less than with Spark's default.
CODEC = "zstd"


def tree(spark: SparkSession, root: str, skip_prefixes: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """path (relative), length, modificationTime, content of all files below a folder, empty ones too, without reserved prefixes.

    Spark's scan leaves out empty files and hidden ones (a part of the path begins with "." or "_"); those are
    listed apart, hidden ones only with ``hidden``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    path = F.regexp_replace("path", F.lit(f"^.*?{_quoted(base)}/"), F.lit(""))
    others = listing.walk(spark, root, hidden)
    others = listing.with_content(spark, root, others.where((F.col("length") == 0) | F.col("path").rlike("(^|/)[._]")))
    rows = files.withColumn("path", path).unionByName(others.select(*files.columns))
    for p in skip_prefixes:
        rows = rows.where(~F.col("path").startswith(p))
    return rows


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def as_objects(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Table rows as objects: path, mode, content."""
    return docs.select(F.lpad(F.col(key).cast("string"), 12, "0").alias("path"), F.lit(0o644).alias("mode"), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("content"))


def blocks(objects: DataFrame, size: int = BLOCK, keep_data: bool = False) -> DataFrame:
    """Fixed-size blocks: path, offset, length, hash (and data).  An empty object has none; it stays in the object index."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    cut: Column = F.expr(f"substring(content, cast(k * {size} + 1 as int), {size})")
    rows = objects.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    rows = rows.select("path", (F.col("k").cast("long") * size).alias("offset"), cut.alias("data"))
    out = rows.select("path", "offset", F.octet_length("data").alias("length"), F.sha2("data", 256).alias("hash"), "data")
    return out if keep_data else out.drop("data")


def object_index(objects: DataFrame, block_rows: DataFrame) -> DataFrame:
    """path, mode, size, chunk_ids in offset order, content_hash (SHA-256 of the joined chunk ids).  Offsets sort as numbers."""
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("offset", "hash"))), lambda x: x["hash"])
    made = block_rows.groupBy("path").agg(F.sum("length").alias("size"), chunks.alias("chunk_ids"))
    return objects.select("path", "mode").join(made, "path", "left").select(
        "path", "mode", F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
    ).withColumn("content_hash", F.sha2(F.encode(F.array_join("chunk_ids", ""), "utf-8"), 256))


def export(objects: DataFrame, uri: str, archive_id: str, epoch: int, size: int = BLOCK, log_lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Writes tables ``chunks`` (each distinct block once), ``objects`` and ``summary`` below ``uri``, and a copy of the log (``log_lines``: value) if one is given.

    The summary counts logical bytes, physical bytes (chunks and log copy), saved bytes, blocks and chunks.
    """
    from ..functions import digests
    from ..operators import dedup

    spark = objects.sparkSession
    cut = blocks(objects, size, keep_data=True)
    dedup.first_chunks(cut).write.parquet(f"{uri}/chunks", compression=CODEC)
    cut = cut.drop("data")
    object_index(objects, cut).write.parquet(f"{uri}/objects", compression=CODEC)
    log_bytes = 0
    if log_lines is not None:
        log_lines.select("value").write.text(f"{uri}/log")
        log_bytes = spark.read.text(f"{uri}/log").agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    index = spark.read.parquet(f"{uri}/objects")
    stats = dedup.stats(cut, log_bytes)
    digests.archive_root(index).crossJoin(stats).select(F.lit(archive_id).alias("archive_id"), F.lit(FORMAT_VERSION).alias("format_version"), F.lit(epoch).cast("long").alias("epoch"), "*").write.parquet(f"{uri}/summary")  # one row each
    return inspect(spark, uri)


def inspect(spark: SparkSession, uri: str) -> dict[str, DataFrame]:
    """The archive's tables; refuses formats newer than this reader."""
    summary = spark.read.parquet(f"{uri}/summary")
    if (found := summary.first()["format_version"]) > FORMAT_VERSION:
        raise ValueError(f"archive format {found} is newer than {FORMAT_VERSION}")
    held = {"summary": summary, "objects": spark.read.parquet(f"{uri}/objects"), "chunks": spark.read.parquet(f"{uri}/chunks")}
    return held | ({"log": spark.read.text(f"{uri}/log")} if tables.exists(spark, f"{uri}/log") else {})


def _wanted(archive: dict[str, DataFrame]) -> DataFrame:
    """path, k, hash, data, fault (missing, damaged; null: sound) of every chunk that an object names."""
    wanted = archive["objects"].select("path", F.posexplode("chunk_ids").alias("k", "hash"))
    held = archive["chunks"].select("hash", "data", (F.sha2("data", 256) == F.col("hash")).alias("_sound"))
    fault = F.when(F.col("data").isNull(), "missing chunk").when(~F.col("_sound"), "damaged chunk")
    return wanted.join(held, "hash", "left").select("path", "k", "hash", "data", fault.alias("fault"))


def restore_blocks(archive: dict[str, DataFrame]) -> DataFrame:
    """path, k, hash, data, fault: the blocks of every object in order of k, for objects of any size.  A chunk that is absent or damaged has no data and says so."""
    return _wanted(archive).withColumn("data", F.when(F.col("fault").isNull(), F.col("data")))


def restore(archive: dict[str, DataFrame]) -> DataFrame:
    """path, mode, content, error: objects put together again from their chunks; for objects that fit a row (see ``restore_blocks``).

    Every chunk is checked before use.  An object with a chunk that is absent or
    damaged, or whose chunk ids do not give its content hash or size, has no content
    and an ``error``; it is never shortened.
    """
    content = F.expr("listagg(data) WITHIN GROUP (ORDER BY k)")
    made = _wanted(archive).groupBy("path").agg(F.max("fault").alias("_fault"), content.alias("_content"))
    listed = F.sha2(F.encode(F.array_join("chunk_ids", ""), "utf-8"), 256) == F.col("content_hash")
    out = archive["objects"].join(made, "path", "left").withColumn("_content", F.coalesce("_content", F.lit(b"")))
    error = F.coalesce("_fault", F.when(~listed, "content hash"), F.when(F.octet_length("_content") != F.col("size"), "size"))
    return out.select("path", "mode", F.when(error.isNull(), F.col("_content")).alias("content"), error.alias("error"))


def is_archive(path: Column, prefix: str) -> Column:
    """Whether the last part of a path begins with the archives' prefix."""
    return F.coalesce(F.element_at(F.split(path, "/"), -1).startswith(prefix), F.lit(False))


def clone(archive: dict[str, DataFrame], uri: str, archive_id: str) -> dict[str, DataFrame]:
    """A copy with an identity of its own."""
    spark = archive["objects"].sparkSession
    archive["chunks"].write.parquet(f"{uri}/chunks", compression=CODEC)
    archive["objects"].write.parquet(f"{uri}/objects", compression=CODEC)
    archive["summary"].withColumn("archive_id", F.lit(archive_id)).write.parquet(f"{uri}/summary")
    return inspect(spark, uri)


def sanitised_clone(archive: dict[str, DataFrame], uri: str, archive_id: str, hooks: list, size: int = BLOCK) -> dict[str, DataFrame]:
    """A clone whose text objects went through the redaction hooks; other objects stay as they are.  The summary counts ``changed_objects``."""
    from ..functions import rules

    plain = _sound(restore(archive))
    text = F.decode("content", "utf-8")
    for hook in hooks:
        text = hook(text)
    is_text = rules.looks_like_text(F.col("path"), F.col("content"))
    clean = plain.withColumn("clean", F.when(is_text, F.encode(text, "utf-8")).otherwise(F.col("content")))
    done = clean.select("path", "mode", F.col("clean").alias("content"), (F.col("clean") != F.col("content")).alias("changed"))
    done = tables.materialise(done, "sanitised", CODEC)
    changed = done.agg(F.count_if("changed").alias("changed_objects"))
    made = export(done.drop("changed"), uri, archive_id, 0, size)
    return made | {"summary": made["summary"].crossJoin(changed)}  # one row each


def _sound(restored: DataFrame) -> DataFrame:
    """Fails on the first object that could not be restored."""
    told = F.concat(F.lit("cannot restore "), "path", F.lit(": "), "error")
    return restored.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(told).cast("boolean")))


RECEIPT = ("archive_id", "objects", "restored", "bytes", "root", "again", "digest_ok", "evidence_hash")


def drill(archive: dict[str, DataFrame], size: int = BLOCK) -> DataFrame:
    """A sealed receipt: restores every object from the archive alone, exports what came back, and compares roots.

    One row: archive_id, objects, restored (without error), bytes, root, again, digest_ok
    (all restored and the roots equal), evidence_hash.  It reads nothing but the
    archive, so it holds after the source is gone.
    """
    from ..functions import digests

    spark = archive["objects"].sparkSession
    back = tables.materialise(restore(archive), "drill-restored", CODEC)
    counts = back.agg(F.count("*").alias("objects"), F.count_if(F.col("error").isNull()).alias("restored"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))
    again = export(back.where("error is null").drop("error"), tables.shared_dir(spark, "drill"), "drill", 0, size)["summary"].select(F.col("root").alias("again"))
    out = archive["summary"].select("archive_id", "root").crossJoin(again).crossJoin(counts)  # one row each
    return digests.seal(out.withColumn("digest_ok", (F.col("root") == F.col("again")) & (F.col("restored") == F.col("objects")))).select(*RECEIPT)
