"""Redaction and rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and their replacements.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SECRET = r'(?i)("?(?:api[_-]?key|password|secret|token)"?\s*[:=]\s*)("?)[^"\s,}\]]+("?)'


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")


def tokenize_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1$2[TOKENIZED]$3")


def redact(df: DataFrame, column: str, hooks: list[Callable[[Column], Column]], is_text: Column | None = None) -> DataFrame:
    """Applies the hooks in order and adds ``changed``; rows that ``is_text`` (given: a boolean) denies or leaves unknown stay as they are."""
    out = F.col(column)
    for hook in hooks:
        out = hook(out)
    if is_text is not None:
        out = F.when(is_text, out).otherwise(F.col(column))
    return df.withColumn("_redacted", out).withColumn("changed", ~F.col("_redacted").eqNullSafe(F.col(column))).drop(column).withColumnRenamed("_redacted", column)


def short_hash(h: Column) -> Column:
    return F.left(h, F.lit(12))


def short_id(i: Column) -> Column:
    return F.left(i, F.lit(7))


def token_tail(t: Column) -> Column:
    return F.right(t, F.lit(4))


def event_line(level: Column, message: Column) -> Column:
    """One line of a lifecycle event, marked by its level."""
    mark = F.when(level == "error", "[x]").when(level == "warn", "[!]").when(level == "success", "[+]").otherwise("[.]")
    return F.concat_ws(" ", mark, message)


def envelope(event: Column) -> Column:
    return F.struct(F.lit(1).alias("schema_version"), event.alias("event"))


def pause_metrics(df: DataFrame, write_ms: str, barrier_ms: str) -> DataFrame:
    """Two metric rows per row: write pause and barrier pause in ms."""
    rest = [c for c in df.columns if c not in (write_ms, barrier_ms)]
    return df.unpivot(rest, [write_ms, barrier_ms], "name", "value").withColumn("unit", F.lit("ms"))


def micros_to_ms(us: Column) -> Column:
    return us / 1000.0


def catalog_line(archive: Column, target: Column, epoch: Column, size: Column, verified: Column) -> Column:
    """One line of a catalog listing."""
    return F.format_string("%-14s %-10s epoch=%d bytes=%d %s", archive, target, epoch, size, F.when(verified, "verified").otherwise("unverified"))


def receipt_line(receipt: Column, phase: Column, synced: Column, pause_ms: Column) -> Column:
    """One line of a deployment receipt."""
    return F.format_string("%s: %s, %d mutations, pause %.3f ms", receipt, phase, synced, pause_ms)
