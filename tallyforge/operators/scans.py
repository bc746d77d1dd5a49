"""Running values over ordered histories of any size, by a two-pass parallel prefix scan.

A window over one key sorts that key's whole history in one task.  Here histories are
cut by range of (key, order) into pieces, so a long history lies in many of them.
Each piece gives its own running values and one summary a key (a sum, a maximum or a
last value); summaries are scanned in the order of the pieces, and every row combines
its piece's value with what the pieces before carry over.  A task sorts a piece, and a
scan of summaries has a row for each piece that a key lies in.

That takes two shuffles and a join of all rows.  ``scan`` spends them on long histories
only: those of up to ``WHOLE`` rows are a plain window each, by one shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

KEY, PIECE, TIE = "_key", "_piece", "_tie"
#: A history of up to so many rows may be sorted in one task.
WHOLE = 1 << 17
#: The running aggregate of each kind.
OVER = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}


class Run(NamedTuple):
    """A running value: ``kind`` is sum, max or last (the newest value that is not null); ``before`` leaves the row itself out."""

    kind: str
    value: Column
    before: bool = False


def running_sum(value: Column, before: bool = False) -> Run:
    return Run("sum", value, before)


def running_count(condition: Column, before: bool = False) -> Run:
    return Run("sum", F.when(condition, 1).otherwise(0).cast("long"), before)


def running_max(value: Column, before: bool = False) -> Run:
    return Run("max", value, before)


def last_value(value: Column, before: bool = False) -> Run:
    return Run("last", value, before)


def previous(*columns: str) -> Run:
    """The row before, as a struct of these columns (null for the first; its fields may be null)."""
    return Run("last", F.struct(*columns), True)


def cut(df: DataFrame, by: list[str], order: list[str], name: str = "pieces") -> DataFrame:
    """``df`` as a written table in pieces, ready for ``run``; rows that are alike in ``order`` keep one order among them.

    Null keys are a key like any other.  The pieces are the partitions of a range
    shuffle whose bounds are sampled, also inside a key and among equal rows.
    """
    rows = df.withColumn(KEY, F.struct(*by)).withColumn(TIE, F.monotonically_increasing_id())
    return tables.materialise(rows.repartitionByRange(KEY, *order, TIE).withColumn(PIECE, F.spark_partition_id()), name)


def run(pieces: DataFrame, by: list[str], order: list[str], columns: dict[str, Run]) -> DataFrame:
    """Adds ``columns`` to a table that ``cut`` wrote, per key of ``by`` in ``order``.

    ``by`` is the key of the cut, or has more columns that never go back to an earlier
    value in the order (as a history's segments).
    """
    rows = pieces.withColumn(KEY, F.struct(*by))
    at = F.struct(*order, TIE)
    inside = Window.partitionBy(KEY, PIECE).orderBy(*order, TIE)
    earlier = Window.partitionBy(KEY).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    whole = {
        "sum": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at)),
    }

    totals = rows.groupBy(KEY, PIECE).agg(*[whole[r.kind](r.value).alias(f"_all_{c}") for c, r in columns.items()])
    carries = totals.select(KEY, PIECE, *[OVER[r.kind](F.col(f"_all_{c}")).over(earlier).alias(f"_carry_{c}") for c, r in columns.items()])
    out = rows
    for c, r in columns.items():
        out = out.withColumn(f"_own_{c}", OVER[r.kind](r.value).over(inside.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)))
    out = out.join(carries, [KEY, PIECE])
    for c, r in columns.items():
        own, carry = F.col(f"_own_{c}"), F.col(f"_carry_{c}")
        both = {"sum": F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)), "max": F.greatest(own, carry), "last": F.coalesce(own, carry)}[r.kind]
        out = out.withColumn(c, both)
    return out.drop(KEY, *[f"_{x}_{c}" for x in ("own", "carry") for c in columns])


def plain(rows: DataFrame) -> DataFrame:
    """Without the columns that ``cut`` added."""
    return rows.drop(KEY, PIECE, TIE)


def whole(rows: DataFrame, order: list[str], columns: dict[str, Run]) -> DataFrame:
    """``run`` by a plain window over ``KEY``: for histories that may be sorted in one task each."""
    inside = Window.partitionBy(KEY).orderBy(*order, TIE)
    for c, r in columns.items():
        value = OVER[r.kind](r.value).over(inside.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0))
        rows = rows.withColumn(c, F.coalesce(value, F.lit(0)) if r.kind == "sum" else value)
    return rows


def scan(df: DataFrame, by: list[str], order: list[str], columns: dict[str, Run], name: str = "pieces") -> DataFrame:
    """``df`` with running ``columns`` per key of ``by`` in ``order``; no task sorts a key of more than ``WHOLE`` rows."""
    rows = tables.materialise(df.withColumn(KEY, F.struct(*by)).withColumn(TIE, F.monotonically_increasing_id()), name)
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= WHOLE:
        return whole(rows, order, columns).drop(KEY, TIE)
    long = tables.materialise(sizes.where(F.col("_n") > WHOLE).select(F.col(KEY).alias("_long")), f"{name}-long")
    is_long = F.col(KEY).eqNullSafe(F.col("_long"))  # one key in WHOLE rows at most, so it may be broadcast
    short = whole(rows.join(F.broadcast(long), is_long, "left_anti"), order, columns).drop(KEY, TIE)
    cut_up = cut(rows.join(F.broadcast(long), is_long, "left_semi").drop(KEY, TIE), by, order, f"{name}-cut")
    return short.unionByName(plain(run(cut_up, by, order, columns)))
