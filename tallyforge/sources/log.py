"""Change-log scan: one JSON object a line, optionally followed by a tab and ``#crc32=`` with 8 hex digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KINDS, MUTATION

TRAILER = r"\t#crc32="
CHECKSUM_FIELD = r',"entry_checksum":"[^"]*"'


def crc_hex(text: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(F.encode(text, "utf-8"))), 8, "0"))


def to_line(body: Column) -> Column:
    """A log line with its trailer."""
    return F.concat(body, F.lit("\t#crc32="), crc_hex(body))


def with_checksum(body: Column) -> Column:
    """Appends ``entry_checksum``: SHA-256 of the record without it.  Exact for lines this writer makes."""
    return F.concat(F.left(body, F.length(body) - 1), F.lit(',"entry_checksum":"'), F.sha2(F.encode(body, "utf-8"), 256), F.lit('"}'))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Mutation columns plus ``raw``, ``crc_ok``, ``parse_ok``, ``checksum_ok``; blank lines are left out.

    A line without a trailer is accepted; a malformed trailer is not.  Missing
    numbers become 0 and missing texts ''.
    """
    parts = F.split(F.col(column), TRAILER, 2)
    body, trailer = parts[0], F.element_at(parts, 2)
    has_trailer = F.size(parts) > 1
    record = F.from_json(body, MUTATION, {"mode": "PERMISSIVE"})
    stripped = F.regexp_replace(body, CHECKSUM_FIELD, "")
    out = lines.where(F.trim(F.col(column)) != "").select(
        "*", F.col(column).alias("raw"), record.alias("_r"),
        F.when(has_trailer, trailer.rlike("^[0-9a-f]{8}$") & (trailer == crc_hex(body))).otherwise(True).alias("crc_ok"),
        F.sha2(F.encode(stripped, "utf-8"), 256).alias("_sum"), body.alias("_body"),
    )
    fields = [f.strip().split(" ") for f in MUTATION.split(",")]
    zero = {"long": F.lit(0).cast("long"), "int": F.lit(0), "string": F.lit("")}
    parsed = F.col("_r").isNotNull() & F.get_json_object("_body", "$.kind").isNotNull() & F.get_json_object("_body", "$.seq").isNotNull()
    rest = [c for c in lines.columns if c != column]
    return out.select(
        *rest, *[F.coalesce(F.col(f"_r.{n}"), zero[t]).alias(n) for n, t in fields], "raw", "crc_ok", parsed.alias("parse_ok"),
        F.when(F.coalesce(F.col("_r.entry_checksum"), F.lit("")) == "", True).otherwise(F.col("_sum") == F.col("_r.entry_checksum")).alias("checksum_ok"),
    ).withColumn("kind_known", F.col("kind").isin(*KINDS))


def scan(spark: SparkSession, path: str, from_seq: int = 0, to_seq: int | None = None, strict: bool = True) -> DataFrame:
    """Records with from_seq <= seq (<= to_seq).  Strict: any damaged line, in range or not, fails the scan; else flags tell."""
    return in_range(parse(spark.read.text(path)), from_seq, to_seq, strict)


def in_range(rows: DataFrame, from_seq: int, to_seq: int | None, strict: bool) -> DataFrame:
    """Parsed lines cut to a range of seq, as ``scan`` does."""
    good = F.col("crc_ok") & F.col("parse_ok") & F.col("checksum_ok")
    if strict:
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("damaged log line: "), "raw")).cast("boolean")))
    rows = rows.where(F.col("seq") >= from_seq)
    return rows if to_seq is None else rows.where(F.col("seq") <= to_seq)


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """Torn-tail recovery: a last line without its newline is left out, whatever it holds; complete lines always stay.

    (file, block, line_no, value): lines of a file are ordered by block and line_no.
    Files are read line by line and may be cut into blocks, so their size has no
    limit.  A file's tail is torn if its lines with a newline each come to one byte
    more than the file.  Files must not be compressed.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value", F.col("_metadata.file_size").alias("_size"),
    )
    ends = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size"), F.max(F.struct("block", "line_no")).alias("_last"))
    torn = ends.where(F.col("_bytes") > F.col("_size")).select("file", F.col("_last.block").alias("block"), F.col("_last.line_no").alias("line_no"))
    return lines.drop("_size").join(torn, ["file", "block", "line_no"], "left_anti")


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes records (MUTATION columns that ``df`` has) as lines with trailers."""
    names = [f.strip().split(" ")[0] for f in MUTATION.split(",")]
    body = F.to_json(F.struct(*[n for n in names if n in df.columns and n != "entry_checksum"]))
    df.select(to_line(with_checksum(body)).alias("value")).write.mode(mode).text(path)
