"""Decision functions: Column in, Column out.  An unknown input never gives a favourable verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The deployment phases and their legal steps.
PHASES = ("ACTIVE", "CHECKPOINT", "SHADOW", "SYNCHRONIZING", "VERIFYING", "QUIESCING", "FINAL_DELTA", "CUTOVER", "OBSERVING", "COMMITTED")
UNSAFE_PHASES = ("ABORTED", "DEGRADED", "RECOVERING", "ROLLED_BACK")
TERMINAL_PHASES = ("COMMITTED", "ABORTED", "ROLLED_BACK")
STEPS = (
    *zip(PHASES, PHASES[1:]),
    ("CHECKPOINT", "ABORTED"), ("SHADOW", "ABORTED"), ("SYNCHRONIZING", "ABORTED"), ("SYNCHRONIZING", "DEGRADED"),
    ("VERIFYING", "ABORTED"), ("VERIFYING", "DEGRADED"), ("QUIESCING", "ABORTED"), ("FINAL_DELTA", "ABORTED"),
    ("CUTOVER", "RECOVERING"), ("OBSERVING", "RECOVERING"), ("OBSERVING", "ROLLED_BACK"), ("DEGRADED", "RECOVERING"),
    ("RECOVERING", "SYNCHRONIZING"), ("RECOVERING", "ABORTED"), ("RECOVERING", "ROLLED_BACK"), ("ABORTED", "ACTIVE"), ("ROLLED_BACK", "ACTIVE"),
)


def surely(condition: Column) -> Column:
    """False where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def is_terminal(phase: Column) -> Column:
    return surely(phase.isin(*TERMINAL_PHASES))


def is_unsafe(phase: Column) -> Column:
    return surely(phase.isin(*UNSAFE_PHASES))


def is_verified(outcome: Column) -> Column:
    return surely(outcome == "VERIFIED")


def is_ready(conclusion: Column) -> Column:
    return surely(conclusion.isin("READY", "READY_WITH_RISK"))


def is_recoverable(conclusion: Column) -> Column:
    return surely(conclusion.isin("RECOVERABLE", "PARTIALLY_RECOVERABLE"))


def gate_allows(decision: Column) -> Column:
    return surely(decision == "ALLOWED")


def compare_epochs(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.sign(a - b).cast("int")


def is_stale_fence(epoch: Column, token: Column, held_epoch: Column, held_token: Column) -> Column:
    """A lower epoch, or the same epoch with a lower token."""
    return surely(F.struct(epoch.alias("e"), token.alias("t")) < F.struct(held_epoch.alias("e"), held_token.alias("t")))


def integrity_label(outcome: Column) -> Column:
    return F.when(outcome == "VERIFIED", "ok").when(outcome.isin("PARTIAL", "FAILED"), "degraded").otherwise("unknown")


#: Extensions taken for text.
TEXT_EXTENSIONS = ("txt", "json", "yaml", "yml", "md", "env", "csv", "log")


def looks_like_text(path: Column, content: Column) -> Column:
    """By extension, or no NUL in the first 512 bytes."""
    head = F.hex(F.substring(content, 1, 512))
    return F.lower(path).rlike(rf"\.({'|'.join(TEXT_EXTENSIONS)})$") | ~surely(head.rlike("^(..)*?00"))


def heat_class(hits: Column, age_s: Column, inclusive: bool = False) -> Column:
    """HOT: 10 hits within 2 s; WARM: 3 within 10 s; COLD: 1 within 60 s; else STATIC."""
    within = (lambda s: age_s <= s) if inclusive else (lambda s: age_s < s)
    return F.when((hits >= 10) & within(2), "HOT").when((hits >= 3) & within(10), "WARM").when((hits >= 1) & within(60), "COLD").otherwise("STATIC")


def heat_rank(heat: Column) -> Column:
    return F.when(heat == "HOT", 3).when(heat == "WARM", 2).when(heat == "COLD", 1).otherwise(0)


def verify_outcome(level: Column, readable: Column, counts_equal: Column, bytes_equal: Column, mismatches: Column, missing: Column, extra: Column, active_files: Column, app_ok: Column) -> Column:
    """VERIFIED, PARTIAL, FAILED or UNKNOWN.  ``app_ok`` null: no application check was given."""
    same = (mismatches == 0) & (missing == 0) & (extra == 0)
    by_hash = F.when(same, "VERIFIED").when((mismatches + missing > 0) & (mismatches < active_files), "PARTIAL").otherwise("FAILED")
    by_app = F.when(app_ok.isNull(), "UNKNOWN").when(app_ok & same, "VERIFIED").when(app_ok, "PARTIAL").otherwise("FAILED")
    return (
        F.when(~surely(readable), "UNKNOWN")
        .when(level == "METADATA", F.when(surely(counts_equal & bytes_equal), "PARTIAL").otherwise("FAILED"))
        .when(level.isin("CHECKSUM", "STRUCTURAL"), by_hash)
        .when(level == "APPLICATION", by_app)
        .otherwise("UNKNOWN")
    )


def gate(c: dict[str, Column], max_pause_ms: float = 250.0) -> tuple[Column, Column, Column]:
    """(reasons, decision, strict_decision) of the cutover gate.

    ``c``: lag, pending, candidate_ok, manifest_ok, journal_ok, rollback_point, coordinator_ok, storage_ok,
    non_convergent, outcome (null counts as UNKNOWN), pause_ms, unverified, override.  With an override,
    ``decision`` lifts every soft block once something needs an override; ``strict_decision`` lifts only that something.
    """
    outcome = F.coalesce(c["outcome"], F.lit("UNKNOWN"))
    blocks = {
        "lag": (c["lag"] > 0) | (c["pending"] > 0),
        "candidate": ~surely(c["candidate_ok"]),
        "manifest": ~surely(c["manifest_ok"]),
        "journal": ~surely(c["journal_ok"]),
        "rollback_point": ~surely(c["rollback_point"]),
        "health": ~(surely(c["coordinator_ok"]) & surely(c["storage_ok"])),
        "non_convergent": F.coalesce(c["non_convergent"], F.lit(True)),
        "unknown": outcome == "UNKNOWN",
        "outcome": ~outcome.isin("VERIFIED", "PARTIAL", "UNKNOWN"),
        "pause": F.coalesce(c["pause_ms"] > max_pause_ms, F.lit(True)),
    }
    overridable = {"partial": outcome == "PARTIAL", "unverified": c["unverified"] > 0}
    hard = ("candidate", "journal", "non_convergent", "unknown", "pause")
    reasons = F.array_compact(F.array(*[F.when(v, k) for k, v in (blocks | overridable).items()]))
    any_of = lambda names: F.greatest(*[F.coalesce((blocks | overridable)[n], F.lit(False)) for n in names])
    blocked, needs, is_hard = any_of(blocks), any_of(overridable), any_of(hard)
    override = surely(c["override"])
    decision = (
        F.when(blocked & ~(override & needs & ~is_hard), "BLOCKED")
        .when(needs & ~override, "REQUIRES_OVERRIDE")
        .otherwise("ALLOWED")
    )
    strict = F.when(blocked, "BLOCKED").when(needs & ~override, "REQUIRES_OVERRIDE").otherwise("ALLOWED")
    return reasons, decision, strict


def plan(c: dict[str, Column]) -> dict[str, Column]:
    """Migration plan.  ``c``: bytes, files, bandwidth, history, write_rate, capacity, can_verify (bandwidth and history: 0 or less takes a default)."""
    bandwidth = F.when(c["bandwidth"] > 0, c["bandwidth"]).otherwise(32.0 * 1024 * 1024)
    history = F.when(c["history"] > 0, c["history"]).otherwise(5000.0)
    rate, copy_s = c["write_rate"], c["bytes"] / bandwidth
    pause = 5.0 + rate / history * 40
    base = (
        F.when((c["capacity"] > 0) & (c["bytes"] > c["capacity"]), "BLOCKED")
        .when(~surely(c["can_verify"]), "BLOCKED")
        .when((rate > 0) & (rate >= history), "LIKELY_NON_CONVERGENT")
        .when(rate > history * 0.7, "READY_WITH_RISK")
        .otherwise("READY")
    )
    confidence = (
        F.when((c["capacity"] > 0) & (c["bytes"] > c["capacity"]), 0.95)
        .when(~surely(c["can_verify"]), 0.7)
        .when((rate > 0) & (rate >= history), 0.8)
        .when(rate > history * 0.7, 0.6)
        .when((c["files"] == 0) & (c["bytes"] == 0) & (rate == 0), 0.9)
        .otherwise(0.7)
    )
    catchup = F.when((history > rate) & (c["files"] > 0), copy_s * rate / history * 1000 + copy_s * 1000).when((history <= rate) & (rate > 0), -1.0).otherwise(0.0)
    return {
        "catchup_ms": catchup,
        "pause_ms": pause,
        "conclusion": F.when((pause > 250) & (base == "READY"), "READY_WITH_RISK").otherwise(base),
        "confidence": confidence,
    }


def live_pause_ms(lag: Column, replication_rate: Column, write_rate: Column) -> Column:
    return 5 + lag / F.when(replication_rate > 0, replication_rate).otherwise(1.0) * 1000 + write_rate * 0.02


def recovery_action(phase: Column, writes_after: Column) -> Column:
    """What to do after a crash, from the phase alone."""
    return (
        F.when(phase.isin(*PHASES[:5]), "RETRY")
        .when(phase.isin("QUIESCING", "FINAL_DELTA"), "ABORT")
        .when((phase == "CUTOVER") & (writes_after > 0), "RECONCILE")
        .when((phase == "CUTOVER") & (writes_after == 0), "ROLLBACK")
        .when(phase == "CUTOVER", "RECONCILE")
        .when(phase == "OBSERVING", "RESUME")
        .when(phase.isin("RECOVERING", "DEGRADED"), "RECONCILE")
        .otherwise("ABORT")
    )


def recovery_class(phase: Column, writes_after: Column, promoted: Column, standby_ok: Column, manifest_ok: Column, journal_ok: Column, observation_failed: Column) -> tuple[Column, Column]:
    """(action, class) from durable evidence."""
    late = phase.isin("CUTOVER", "OBSERVING", "RECOVERING")
    early = phase.isin("SYNCHRONIZING", "VERIFYING", "QUIESCING", "FINAL_DELTA")
    cases = (
        (late & promoted & (writes_after > 0), "RECONCILE", "MANUAL_RECONCILIATION"),
        (late & promoted & observation_failed & standby_ok & (writes_after == 0), "ROLLBACK", "ROLLBACK_SAFE"),
        (late & ~promoted & journal_ok, "RESUME", "FORWARD_RECOVERY"),
        (late, "RETRY", "FORWARD_RECOVERY"),
        (early & ~(surely(journal_ok) & surely(manifest_ok)), "ABORT", "ROLLBACK_SAFE"),
        (early, "RESUME", "FORWARD_RECOVERY"),
    )
    action, kind = F.when(surely(cases[0][0]), cases[0][1]), F.when(surely(cases[0][0]), cases[0][2])
    for condition, a, k in cases[1:]:
        action, kind = action.when(surely(condition), a), kind.when(surely(condition), k)
    return action.otherwise("ABORT"), kind.otherwise("MANUAL_RECONCILIATION")


def rollback_safety(writes_after: Column, phase: Column) -> Column:
    return F.when(writes_after == 0, "SAFE").when(phase.isin("OBSERVING", "CUTOVER"), "REQUIRES_RECONCILIATION").otherwise("UNSAFE")


def rollback_permitted(safety: Column, forced: Column, found_hash: Column, expected_hash: Column) -> Column:
    """Only if safe or forced, and the standby's digest is as expected (none expected: any)."""
    return (surely(safety == "SAFE") | surely(forced)) & F.coalesce(found_hash == expected_hash, expected_hash.isNull())


def strategies(capabilities: Column) -> Column:
    has = lambda *names: F.arrays_overlap(capabilities, F.array(*map(F.lit, names)))
    return F.array_compact(F.array(
        F.when(has("snapshot", "incremental-snapshot"), "snapshot-seed").otherwise("baseline-copy"),
        F.when(has("change-tracking", "block-read"), "block-differential").otherwise("journal-replay"),
        F.when(has("freeze"), "write-barrier-freeze"),
        F.when(has("checksum"), "checksum-verify"),
        F.when(has("atomic-rename"), "atomic-pointer-cutover"),
        F.when(has("copy-on-write"), "cow-candidate"),
    ))


def dr_conclusion(archive_present: Column, archive_verified: Column, path_known: Column) -> Column:
    return (
        F.when(~surely(archive_present), "NOT_RECOVERABLE")
        .when(~surely(archive_verified), "PARTIALLY_RECOVERABLE")
        .when(surely(path_known), "RECOVERABLE")
        .otherwise("UNKNOWN")
    )


def tuned(condition_count: Column, knob: str) -> Column:
    """Value of an adaptive knob after its condition held ``condition_count`` times: the closed form of the bounded step."""
    k = condition_count
    return {
        "batch": F.least(F.lit(512), F.lit(64) * F.pow(F.lit(2.0), F.least(k, F.lit(3)))).cast("int"),
        "concurrency": F.least(F.lit(8), 2 + k).cast("int"),
        "verify_every": F.element_at(F.array(*map(F.lit, (1000, 500, 250, 125, 62))), (F.least(k, F.lit(4)) + 1).cast("int")),
        "compression": k > 0,
    }[knob]
