"""Activity, lag, convergence, tuning and observation over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import scans


def heat(log: DataFrame, key: str, at: str, seq: str, size: str, now: Column, inclusive: bool = False, second_s: float = 1.0) -> DataFrame:
    """Per key: hits, bytes, last observed time (by arrival, not the largest), age in seconds, class and rank.

    ``second_s``: what counts as a second of age, for logs whose events lie further apart.
    """
    scored = log.groupBy(key).agg(F.count("*").alias("hits"), F.sum(size).alias("bytes"), F.max_by(at, seq).alias("last_at"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))
    out = scored.withColumn("age_s", age / (1e6 * second_s)).withColumn("heat", rules.heat_class(F.col("hits"), F.col("age_s"), inclusive))
    return out.withColumn("heat_rank", rules.heat_rank(F.col("heat")))


def partition_paths(scored: DataFrame) -> DataFrame:
    """Adds ``stream``: hot and warm keys synchronise continuously, others by baseline copy."""
    return scored.withColumn("stream", F.when(F.col("heat").isin("HOT", "WARM"), "continuous").otherwise("baseline"))


def lag_metrics(log: DataFrame, cursor: Column, by: list[str], replication_rate: Column, integrity_ok: Column, seq: str = "seq", size: str = "size", payload: str | None = None, at: str = "ts") -> DataFrame:
    """Pending records from the cursor on: count, bytes, oldest, ETA in ms (-1 and null-able twin: unknown) and readiness."""
    weight = F.greatest(F.col(size), F.octet_length(payload)) if payload else F.col(size)
    pending = F.col(seq) >= cursor
    out = log.groupBy(*by).agg(
        F.count_if(pending).alias("lag_ops"), F.coalesce(F.sum(F.when(pending, weight)), F.lit(0)).alias("lag_bytes"),
        F.min(F.when(pending, F.col(seq))).alias("oldest_seq"), F.min_by(F.when(pending, F.col(at)), F.when(pending, F.col(seq))).alias("oldest_at"),
    )
    eta = F.when(F.col("lag_ops") == 0, 0.0).when(replication_rate > 0, F.col("lag_ops") / replication_rate * 1000)
    return out.withColumn("eta_ms", F.coalesce(eta, F.lit(-1.0))).withColumn("eta_known_ms", eta).withColumn("ready", (F.col("lag_ops") == 0) & rules.surely(integrity_ok))


def convergence(samples: DataFrame, by: list[str], at: str, backlog: str, write_rate: str, replication_rate: str) -> DataFrame:
    """Adds velocity (backlog change a second; 0 for the first), non_convergent, eta_ms (-1 unknown), improving, mitigations."""
    rows = scans.scan(samples, by, [at], {"_before": scans.previous(at, backlog)}, "convergence")
    seconds = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(f"_before.{at}").cast("timestamp"))) / 1e6
    moved = F.col(backlog) - F.col(f"_before.{backlog}")
    spare = F.col(replication_rate) - F.col(write_rate)
    stuck = (spare <= 0) & (F.col(backlog) > 0)
    return rows.select(
        *samples.columns, F.when(seconds > 0, moved / seconds).otherwise(0.0).alias("velocity"), stuck.alias("non_convergent"),
        F.when(F.col(backlog) == 0, 0.0).when(spare > 0, F.col(backlog) / spare * 1000).otherwise(-1.0).alias("eta_ms"),
        F.coalesce(moved < 0, F.lit(False)).alias("improving"),
        F.when(stuck, F.array(*map(F.lit, ("raise-bandwidth", "throttle-writes", "prioritise-hot-keys", "extend-window")))).otherwise(F.array().cast("array<string>")).alias("mitigations"),
    )


def tuning_conditions(lag: str, write_rate: str, throughput: str, cpu: str, mem: str, storage_lag: str) -> dict[str, Column]:
    """When a sample turns each knob."""
    return {
        "batch": (F.col(lag) > 100) & (F.col(cpu) < 0.85),
        "compression": (F.col(write_rate) > 100) & (F.col(throughput) > 0),
        "concurrency": (F.col(lag) > 500) & (F.col(mem) < 0.8),
        "verify_every": F.col(storage_lag) > 0.5,
    }


def tuning(samples: DataFrame, by: list[str], at: str, lag: str, write_rate: str, throughput: str, cpu: str, mem: str, storage_lag: str) -> DataFrame:
    """The four bounded knobs after each sample, and which of them this sample changed.

    Each knob depends on how often its condition held so far, so running counts
    replace a fold from sample to sample.
    """
    held = tuning_conditions(lag, write_rate, throughput, cpu, mem, storage_lag)
    out = scans.scan(samples, by, [at], {f"_{knob}": scans.running_count(condition) for knob, condition in held.items()}, "tuning")
    for knob, condition in held.items():
        now = rules.tuned(F.col(f"_{knob}"), knob)
        was = rules.tuned(F.col(f"_{knob}") - F.when(condition, 1).otherwise(0), knob)
        out = out.withColumn(knob, now).withColumn(f"{knob}_changed", now != was)
    return out.drop(*[f"_{k}" for k in held])


def observation(polls: DataFrame, by: list[str], healthy: str, error: str, at: str, need: int, max_failures: int = 3) -> DataFrame:
    """Per window: polls, healthy polls, errors, passed (enough healthy polls, none of the failures in a row limit), aborted."""
    marked = scans.scan(polls, by, [at], {"_run": scans.running_count(F.col(healthy))}, "polls")
    streaks = marked.where(~F.col(healthy)).groupBy(*by, "_run").agg(F.count("*").alias("_streak")).groupBy(*by).agg(F.max("_streak").alias("_worst"))
    out = polls.groupBy(*by).agg(F.count("*").alias("polls"), F.count_if(F.col(healthy)).alias("healthy_polls"), F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("errors"))
    out = out.join(streaks, by, "left").withColumn("aborted", F.coalesce(F.col("_worst") >= max_failures, F.lit(False))).drop("_worst")
    return out.withColumn("passed", ~F.col("aborted") & (F.col("healthy_polls") >= need))


def illegal_steps(history: DataFrame, by: list[str], at: str, phase: str, steps: DataFrame) -> DataFrame:
    """History rows whose step from the phase before is no self-loop and not in ``steps`` (from_phase, to_phase; a small fixed table)."""
    moved = scans.scan(history, by, [at], {"_before": scans.previous(phase)}, "phases").withColumn("from_phase", F.col(f"_before.{phase}")).where(F.col("from_phase").isNotNull() & (F.col("from_phase") != F.col(phase)))
    edges = steps.select("from_phase", F.col("to_phase").alias(phase))
    return moved.join(F.broadcast(edges), ["from_phase", phase], "left_anti").select(*by, at, "from_phase", phase)


def history_length(samples: DataFrame, by: list[str]) -> DataFrame:
    """Samples held of each series."""
    return samples.groupBy(*by).agg(F.count("*").alias("samples"))
