"""Catalogs of archives, recovery points and deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from . import scans


def as_of(points: DataFrame, by: list[str], queries: DataFrame, epoch: str, created: str, wanted: str, greatest_epoch: bool = False) -> DataFrame:
    """For each query row the newest-created point (or the one with the greatest epoch) with epoch <= wanted, per key.

    Points and queries of a key are merged in epoch order and the best point so
    far is carried along, so no pairs of them arise.
    """
    others = [c for c in points.columns if c not in by]
    p = points.select(*by, F.col(epoch).alias("_at"), F.lit(0).alias("_query"), F.struct(*others).alias("_point"), *[F.lit(None).cast(t).alias(f"_q_{c}") for c, t in queries.dtypes if c not in by])
    q = queries.select(*by, F.col(wanted).alias("_at"), F.lit(1).alias("_query"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), *[F.col(c).alias(f"_q_{c}") for c, _ in queries.dtypes if c not in by])
    rank = F.struct(F.col(f"_point.{epoch}"), F.col(f"_point.{created}")) if greatest_epoch else F.struct(F.col(f"_point.{created}"), F.col(f"_point.{epoch}"))
    best = scans.running_max(F.when(F.col("_point").isNotNull(), F.struct(rank.alias("r"), F.col("_point").alias("p"))))
    out = scans.scan(p.unionByName(q), by, ["_at", "_query"], {"_best": best}, "as-of").where("_query = 1")
    return out.select(*by, *[F.col(f"_q_{c}").alias(c) for c in queries.columns if c not in by], *[F.col(f"_best.p.{c}").alias(c) for c in others])


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(at), key)


def latest_open(rows: DataFrame, by: list[str], at: str, key: str, is_closed, columns: list[str]) -> DataFrame:
    """Per group the latest row that is not closed; ties go to the larger key."""
    best = F.max(F.struct(F.col(at), F.col(key), *[F.col(c) for c in columns])).alias("_best")
    return rows.where(~is_closed).groupBy(*by).agg(best).select(*by, f"_best.{at}", f"_best.{key}", *[f"_best.{c}" for c in columns])


def attach_drills(catalog: DataFrame, drills: DataFrame, key: str, ran_at: str, columns: list[str]) -> DataFrame:
    """Adds ``last_drill``, the latest drill of each entry (null: none)."""
    last = drills.groupBy(key).agg(F.max(F.struct(F.col(ran_at), *[F.col(c) for c in columns])).alias("last_drill"))
    return catalog.join(last, key, "left")


def lookup(wanted: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Each wanted key with its entry's columns and ``found``; an unknown key has nulls and false.  Repeated entries give a row each."""
    return wanted.join(catalog.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def prune(rows: DataFrame, key: str, value) -> DataFrame:
    """Without the row of this key; a key that is absent is an error when the result is read.

    The count of what goes is one row, so nothing runs while the plan is made.
    """
    gone = rows.agg(F.count_if(F.col(key) == value).alias("_gone"))
    told = F.raise_error(F.lit(f"{key} {value} is not in the catalog")).cast("boolean")
    return rows.crossJoin(F.broadcast(gone)).where(F.when(F.col("_gone") == 0, told).otherwise(True)).where(F.col(key) != value).drop("_gone")


def dr_scorecard(entries: DataFrame, points: DataFrame, by: list[str], stored_at: str, key: str, verified: str, path: str, drill_ok: str) -> DataFrame:
    """Per group of entries and points: evidence flags of the latest entry and the conclusion."""
    latest = entries.groupBy(*by).agg(F.max(F.struct(F.col(stored_at), F.col(key), F.col(verified).alias("verified"), F.col(path).alias("path"), F.col(drill_ok).alias("drill_ok"))).alias("e"), F.count("*").alias("archives"))
    known = points.groupBy(*by).agg(F.count("*").alias("points"), F.max(F.col("kind") == "JOURNAL_CHAIN").alias("journal_chain"))
    out = latest.join(known, by, "full_outer").select(
        *by, F.coalesce("archives", F.lit(0)).alias("archives"), F.coalesce("points", F.lit(0)).alias("points"), rules.surely(F.col("journal_chain")).alias("journal_chain"),
        F.col("e").isNotNull().alias("archive_present"), rules.surely(F.col("e.verified")).alias("archive_verified"), rules.surely(F.col("e.path") != "").alias("path_known"),
        F.col("e.drill_ok").isNotNull().alias("drill_recorded"), rules.surely(F.col("e.drill_ok")).alias("drill_ok"),
    )
    return out.withColumn("conclusion", rules.dr_conclusion(F.col("archive_present"), F.col("archive_verified"), F.col("path_known")))


def capability_match(offered, wanted):
    """(negotiated, missing) as array columns."""
    return F.array_sort(F.array_intersect(offered, wanted)), F.array_sort(F.array_except(wanted, offered))


def chaos_matrix(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per scenario whether detection and recovery were as expected; scenarios that did not run fail."""
    got = actual.select("scenario", "detected", "recovered", "action_taken")
    out = expected.join(got, "scenario", "left")
    return out.withColumn("passed", rules.surely((F.col("detected") == F.col("expect_detection")) & (F.col("action_taken") == F.col("expect_action")) & F.col("recovered")))


def chaos_score(matrix: DataFrame) -> DataFrame:
    """One row: scenarios, how many passed, and whether all did."""
    out = matrix.agg(F.count("*").alias("scenarios"), F.count_if("passed").alias("passed"))
    return out.withColumn("all_passed", F.col("scenarios") == F.col("passed"))


def first_metric(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.where(F.col("name") == name).groupBy("name").agg(F.min_by("value", "ts").alias("value"))


def row_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
