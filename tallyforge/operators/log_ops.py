"""Audit, deduplication, append and fold of change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..schema import KINDS
from ..sources import tables
from . import scans


def head(log: DataFrame) -> DataFrame:
    """One row for reopening: next_seq, epoch, fence, records."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"), F.coalesce(F.max("epoch"), F.lit(0)).alias("epoch"), F.coalesce(F.max("fence_token"), F.lit(0)).alias("fence"), F.count("*").alias("records"))


def sequence_audit(log: DataFrame, by: list[str], order: str, seq: str = "seq") -> DataFrame:
    """Adds previous seq, ``regression``, ``duplicate`` and ``gap`` (records skipped) in log order."""
    rows = scans.scan(log, by, [order], {"previous": scans.previous(seq)}, "sequence")
    step = F.col(seq) - F.col("previous")
    return rows.withColumn("previous", F.col(f"previous.{seq}")).withColumn("regression", F.coalesce(step < 0, F.lit(False))).withColumn("duplicate", F.coalesce(step == 0, F.lit(False))).withColumn("gap", F.coalesce(F.greatest(step - 1, F.lit(0)), F.lit(0)))


def first_of_op(log: DataFrame, op: str = "client_op_id", seq: str = "seq", tie: str | None = None) -> DataFrame:
    """One record wins per op id: the smallest seq, and of those the smallest ``tie`` (an order of arrival; without one: any of them).

    Adds ``effective_seq`` and ``is_first``.  Records without an op id stand for
    themselves.  The first per id is a hash aggregate that is joined back, so a much
    repeated id is not sorted in one task.
    """
    named = F.coalesce(op, F.lit("")) != ""
    rows = log if tie else tables.materialise(log.withColumn("_tie", F.monotonically_increasing_id()), "first-of-op")
    order = tie or "_tie"
    first = rows.where(named).groupBy(op).agg(F.min(seq).alias("_first"))
    seen = rows.join(first, op, "left")
    winner = seen.where(F.col(seq) == F.col("_first")).groupBy(op).agg(F.min(order).alias("_winner"))
    out = seen.join(winner, op, "left").withColumn("effective_seq", F.coalesce("_first", seq))
    return out.withColumn("is_first", ~named | ((F.col(seq) == F.col("_first")) & (F.col(order) == F.col("_winner")))).drop("_first", "_winner", "_tie")


def stale_fences(log: DataFrame, by: list[str], token: str = "fence_token", seq: str = "seq") -> DataFrame:
    """Adds ``held`` (largest token before) and ``stale``: both tokens non-zero and this one lower."""
    rows = scans.scan(log, by, [seq], {"held": scans.running_max(F.col(token), before=True)}, "fences")
    return rows.withColumn("held", F.coalesce("held", F.lit(0))).withColumn("stale", (F.col("held") > 0) & (F.col(token) > 0) & (F.col(token) < F.col("held")))


def append(log: DataFrame, incoming: DataFrame, fence: int | None = None) -> DataFrame:
    """``incoming`` (``arrival`` gives its order) as records of the log: with seq, the log's epoch, and its fence where they bring none.

    A record with a token below the fence is refused first and not remembered, so
    the same op id may come again with a valid token.  Of the others the first per op
    id counts, unless the log has the id.  The fence is ``fence``, or else the largest
    token of the log; a batch is judged by the fence it meets.  Equal rows with an op
    id are one record, those without stand for themselves.  Numbers follow the log's
    last one without a gap; they are dealt by ranges of arrival, so a batch may have
    any size.
    """
    start = head(log).select("next_seq", F.col("epoch").alias("_epoch"), (F.col("fence") if fence is None else F.lit(fence)).cast("long").alias("_fence"))  # one row
    token = F.coalesce(F.col("fence_token"), F.lit(0))
    valid = incoming.crossJoin(F.broadcast(start)).where((token == 0) | (F.col("_fence") == 0) | (token >= F.col("_fence")))
    valid = tables.materialise(valid.withColumn("_row", F.monotonically_increasing_id()), "append-valid")
    fresh = first_of_op(valid, seq="arrival", tie="_row").where("is_first").drop("effective_seq", "is_first")
    fresh = fresh.join(log.where("client_op_id <> ''").select("client_op_id").distinct(), "client_op_id", "left_anti")
    rows = tables.numbered(fresh, ["arrival", "_row"], "_rank", "append")
    rows = rows.withColumn("seq", F.col("next_seq") + F.col("_rank")).withColumn("epoch", F.col("_epoch")).withColumn("fence_token", F.when(token == 0, F.col("_fence")).otherwise(token))
    return rows.drop("next_seq", "_epoch", "_fence", "_row", "_rank", "arrival")


def with_op_ids(incoming: DataFrame, deployment: str) -> DataFrame:
    """Records of an application, each with an op id: its own, or the deployment's name and its arrival number."""
    made = F.concat(F.lit(f"{deployment}-"), F.col("arrival").cast("string"))
    return incoming.withColumn("client_op_id", F.when(F.coalesce("client_op_id", F.lit("")) == "", made).otherwise(F.col("client_op_id")))


class LogSink:
    """A change log in a folder, one subfolder a batch; a repeated batch replaces itself, so appends happen once."""

    def __init__(self, spark: SparkSession, uri: str, schema: str, fence: int | None = None):
        self.spark, self.uri, self.schema, self.fence = spark, uri.rstrip("/"), schema, fence

    def _batches(self, without: int | None) -> list[str]:
        left_out = None if without is None else f"batch={without:09d}"
        names = [n for n in tables.children(self.spark, self.uri) if n.startswith("batch=") and n != left_out]
        return [f"{self.uri}/{n}" for n in names if tables.exists(self.spark, f"{self.uri}/{n}/_SUCCESS")]

    def read(self, without: int | None = None) -> DataFrame:
        """All records so far (but those of one batch)."""
        found = self._batches(without)
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def write(self, incoming: DataFrame, batch: int) -> None:
        """Appends one batch; also the function to give to ``foreachBatch``."""
        log = self.read(without=batch)
        append(log, incoming, self.fence).select(*log.columns).write.mode("overwrite").parquet(f"{self.uri}/batch={batch:09d}")


def latest(log: DataFrame, key: str, seq: str, kind: str, deleted: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """Last writer wins: one newest record per key, keys whose newest record is a delete left out.

    Of a key's records with the largest seq the one with the largest ``tie`` (the
    place in the log) counts; records alike in that, or without it, go by the largest
    kind and then ``columns``.  The largest seq per key is a hash aggregate, and only
    its records are joined back and compared, which avoids sorting whole records.
    """
    newest = log.groupBy(key).agg(F.max(seq).alias(seq))
    order = [*([tie] if tie else []), kind, *[c for c in columns if c != kind]]
    best = log.join(newest, [key, seq]).groupBy(key, seq).agg(F.max(F.struct(*order)).alias("_best"))
    return best.where(F.col(f"_best.{kind}") != deleted).select(key, seq, f"_best.{kind}", *[f"_best.{c}" for c in columns])


_WRITES = ("create", "write", "truncate")


def _ancestors(path: str):
    """The path and all folders above it."""
    whole = F.col(path)
    return F.transform(F.sequence(F.lit(1), F.size(F.split(whole, "/"))), lambda n: F.call_function("substring_index", whole, F.lit("/"), n))


def _last_before(rows: DataFrame, marks: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds ``out``: the largest seq of ``marks`` below the row's own, per group of ``by``."""
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks.select(*by, "seq", F.lit(True).alias("_mark")), allowMissingColumns=True)
    scanned = scans.scan(both, by, ["seq"], {out: scans.running_max(F.when(F.col("_mark"), F.col("seq")), before=True)}, "replay-before")
    return scanned.where("not _mark").drop("_mark")


def _latest_before(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds ``_at``: the version that came to the row's path last before it, as (end, token)."""
    marks = versions.select("resource", "path", "seq", "history", F.struct(F.col("end.seq").alias("end"), "token").alias("_version"))
    both = rows.withColumn("_asks", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    scanned = scans.scan(both, ["resource", "path"], ["seq", "history"], {"_at": scans.last_value(F.col("_version"), before=True)}, "replay-at")
    return scanned.where("_asks").drop("_asks", "_version", "history")


def _first_after(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``_event``: the first event at the row's path after its seq, as (seq, kind, path, dest_path)."""
    marks = events.select("resource", "path", (-F.col("seq")).alias("_back"), F.struct("seq", "kind", "path", "dest_path").alias("_mark"))
    both = rows.withColumn("_back", -F.col("seq")).unionByName(marks, allowMissingColumns=True)
    scanned = scans.scan(both, ["resource", "path"], ["_back"], {"_event": scans.last_value(F.col("_mark"), before=True)}, "replay-after")
    return scanned.where("_mark is null").drop("_mark", "_back")


def _versions(writes: DataFrame, events: DataFrame) -> DataFrame:
    """Where each written object lay and when: resource, token (the write), path, seq (from when on), history, end (the rename or delete that ended it).

    Each round finds, for the objects that the round before moved, the first rename or
    delete of their path or a folder above it.  Objects that lie at one path share
    whatever happens to it from then on, so only the one that came last goes on to
    the next round; ``history`` (earlier arrivals, newest first) tells which did.
    There are as many rounds as one object has moves.
    """
    named = events.select("resource", "path").distinct()
    now = writes.select("resource", F.col("seq").alias("token"), "path", "seq", F.array().cast("array<bigint>").alias("history"))
    done = []
    while True:
        above = now.select("resource", "token", "seq", F.explode(_ancestors("path")).alias("path")).join(named, ["resource", "path"], "left_semi")
        ends = _first_after(above, events).groupBy("token").agg(F.min("_event").alias("end"))
        done.append(tables.materialise(now.join(ends, "token", "left"), f"replay-versions-{len(done)}"))
        moved = done[-1].where("end.kind = 'rename'")
        if moved.isEmpty():
            break
        last = moved.groupBy("resource", "path", "end").agg(F.max(F.struct("seq", "history", "token")).alias("v"))
        to = F.concat("end.dest_path", F.col("path").substr(F.length("end.path") + 1, F.length("path")))
        now = last.select("resource", F.col("v.token").alias("token"), to.alias("path"), F.col("end.seq").alias("seq"), F.concat(F.array("v.seq"), "v.history").alias("history"))
    return reduce(DataFrame.unionByName, done)


def _replay_moving(log: DataFrame) -> DataFrame:
    """Replay of resources with renames: objects are followed from rename to rename by joins, a round a move.

    Records after a resource's first error do not matter for those before it, so all
    are followed first; then each resource is cut at its first error.
    """
    log = log.select("resource", "seq", "kind", "path", "dest_path", "offset", "mode", "size", "content_hash")
    writes, modes = log.where(F.col("kind").isin(*_WRITES) & (F.coalesce("offset", F.lit(0)) == 0)), log.where("kind = 'chmod'")
    versions = _versions(writes, log.where("kind in ('rename', 'delete')"))
    asked = tables.materialise(_latest_before(modes.select("resource", "path", "seq", "mode"), versions), "replay-modes")
    there = F.coalesce(F.col("_at").isNotNull() & (F.col("_at.end").isNull() | (F.col("_at.end") > F.col("seq"))), F.lit(False))
    missing = F.concat(F.lit("no such path "), "path").alias("error")
    moved = versions.where("end.kind = 'rename'").select("resource", F.col("end.seq").alias("seq")).distinct()
    idle = log.where("kind = 'rename'").join(moved, ["resource", "seq"], "left_anti").select("resource", "seq", missing)
    faults = _wrong(log).unionByName(asked.where(~there).select("resource", "seq", missing)).unionByName(idle)
    ends = _ends(log, faults)

    def until(rows):
        return rows.join(ends.select("resource", "_stop"), "resource").where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop")))

    applied = until(log).groupBy("resource").agg(F.count("*").alias("applied"))
    alive = until(versions).where(F.col("end").isNull() | (F.col("_stop").isNotNull() & (F.col("end.seq") >= F.col("_stop"))))
    alive = alive.groupBy("resource", "path").agg(F.max(F.struct("seq", "history", "token")).alias("v")).select("resource", "path", F.col("v.token").alias("token"))
    mode = until(asked.where(there)).groupBy(F.col("_at.token").alias("token")).agg(F.max(F.struct("seq", "mode")).alias("_m"))
    made = writes.select(F.col("seq").alias("token"), F.col("mode").alias("_written"), "content_hash", "size")
    alive = alive.join(made, "token").join(mode, "token", "left")
    alive = alive.select("resource", "path", _mode(F.when(F.col("_m").isNotNull(), F.col("_m.mode")).otherwise(F.col("_written"))).alias("mode"), "content_hash", F.col("size").cast("long").alias("size"))
    return _with_ends(ends, applied, alive)


def _mode(mode):
    """Mode 0 is the default one."""
    return F.when(F.coalesce(mode, F.lit(0)) == 0, 0o644).otherwise(mode).cast("int")


def _wrong(log: DataFrame) -> DataFrame:
    """resource, seq, error of records that fail by themselves."""
    error = F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("unknown kind "), "kind")).when(F.col("kind").isin(*_WRITES) & (F.col("offset") != 0), "range writes are not supported")
    return log.select("resource", "seq", error.alias("error")).where("error is not null")


def _ends(log: DataFrame, faults: DataFrame) -> DataFrame:
    """resource, _stop (seq of its first error) and error; nulls where there is none."""
    first = faults.groupBy("resource").agg(F.min(F.struct("seq", "error")).alias("_end"))
    return log.select("resource").distinct().join(first, "resource", "left").select("resource", F.col("_end.seq").alias("_stop"), F.col("_end.error").alias("error"))


def _with_ends(ends: DataFrame, applied: DataFrame, alive: DataFrame) -> DataFrame:
    out = ends.drop("_stop").join(applied, "resource", "left").join(alive, "resource", "left")
    return out.select("resource", "path", "mode", "content_hash", "size", F.coalesce("applied", F.lit(0)).cast("long").alias("applied"), "error")


def _replay_in_place(log: DataFrame) -> DataFrame:
    """Replay of resources without renames, by aggregates over paths: an object lives if its last write is later than the last delete of it or a folder above it.

    A resource stops at its first error: an unknown kind, a range write, or a mode
    for an object that does not live then.
    """
    log = log.select("resource", "seq", "kind", "path", "offset", "mode", "size", "content_hash")
    writes, deletes, modes = log.where(F.col("kind").isin(*_WRITES)), log.where("kind = 'delete'"), log.where("kind = 'chmod'")
    asked = _last_before(modes.select("resource", "path", "seq"), writes, ["resource", "path"], "_written")
    above = asked.select("resource", "seq", "_written", F.col("path").alias("_path"), F.explode(_ancestors("path")).alias("path"))
    above = _last_before(above, deletes, ["resource", "path"], "_deleted")
    absent = above.groupBy("resource", "seq", "_path", "_written").agg(F.max("_deleted").alias("_deleted"))
    absent = absent.where(F.col("_written").isNull() | (F.col("_deleted") > F.col("_written"))).select("resource", "seq", F.concat(F.lit("no such path "), "_path").alias("error"))
    ends = _ends(log, absent.unionByName(_wrong(log)))

    valid = log.join(ends.select("resource", "_stop"), "resource").where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")
    applied = valid.groupBy("resource").agg(F.count("*").alias("applied"))
    key = ["resource", "path"]
    put = valid.where(F.col("kind").isin(*_WRITES)).groupBy(*key).agg(F.max(F.struct("seq", "mode", "content_hash", "size")).alias("_w"))
    gone = valid.where("kind = 'delete'").groupBy("resource", F.col("path").alias("_above")).agg(F.max("seq").alias("_gone"))
    under = put.select(*key, F.explode(_ancestors("path")).alias("_above")).join(gone, ["resource", "_above"]).groupBy(*key).agg(F.max("_gone").alias("_gone"))
    mode = valid.where("kind = 'chmod'").groupBy(*key).agg(F.max(F.struct("seq", "mode")).alias("_m"))
    alive = put.join(under, key, "left").where(F.col("_gone").isNull() | (F.col("_w.seq") > F.col("_gone"))).join(mode, key, "left")
    newest = F.when(F.col("_m.seq") > F.col("_w.seq"), F.col("_m.mode")).otherwise(F.col("_w.mode"))
    alive = alive.select(*key, _mode(newest).alias("mode"), F.col("_w.content_hash").alias("content_hash"), F.col("_w.size").cast("long").alias("size"))
    return _with_ends(ends, applied, alive)


def replay(log: DataFrame) -> DataFrame:
    """Ordered replay with renames and subtree deletes: resource, path, mode, content_hash, size, applied, error.

    Writes are whole objects; mode 0 is 0644.  Records of a resource go by seq, those
    that share one by kind, path, destination and content.  A resource stops at its
    first error, keeping earlier effects; one with no objects left gives one row with
    a null path.  What a rename brings replaces what lies at its new paths and leaves
    the rest there.  Resources without renames are replayed by aggregates over paths,
    the others by following objects from rename to rename; neither gathers a
    resource's log in one task.
    """
    names = ["resource", "seq", "kind", "path", "dest_path", "offset", "mode", "size", "content_hash"]
    rows = tables.numbered(log.select(*names), ["resource", "seq", "kind", "path", "dest_path", "content_hash"], "_order", "replay-log")
    rows = rows.drop("seq").withColumnRenamed("_order", "seq")
    moves = F.coalesce(F.max(F.col("kind") == "rename"), F.lit(False)).alias("moves")
    every, some = rows.groupBy("resource").agg(moves).agg(F.min("moves"), F.max("moves")).first()
    if not some or every:  # one kind of resources only
        return _replay_moving(rows) if some else _replay_in_place(rows)
    renamed = rows.where("kind = 'rename'").select("resource").distinct()
    return _replay_in_place(rows.join(renamed, "resource", "left_anti")).unionByName(_replay_moving(rows.join(renamed, "resource", "left_semi")))


def delta(log: DataFrame, cursor: int, barrier: int | None = None) -> DataFrame:
    """Records from the cursor on, up to (not including) the barrier: also a one-shot sync from a cursor."""
    rows = log.where(F.col("seq") >= cursor)
    return rows if barrier is None else rows.where(F.col("seq") < barrier)


def caught_up(state: DataFrame, pending: DataFrame, key: str, seq: str, kind: str, deleted: str, columns: list[str]) -> DataFrame:
    """A state (key, seq, kind, columns; as ``latest`` gives it) after pending records: the final delta of a catch-up."""
    kept = [key, seq, kind, *columns]
    return latest(state.select(*kept).unionByName(pending.select(*kept)), key, seq, kind, deleted, columns)


def epochs(log: DataFrame, by: str, order: str, action: str, epoch: str) -> DataFrame:
    """Assigned epoch after each action: commit adds one, advance takes the named epoch if it is higher, all others (rollback, force) pin it.

    Pins cut a history into segments.  In one, the epoch is the commits so far plus
    the largest lead: the pin's epoch, or what an advance named less the commits
    before it.  Running windows replace a fold from record to record.
    """
    key, at = F.col(by).cast("string"), F.col(order).cast("long")
    rows = log.select(key.alias(by), at.alias(order), action, F.col(epoch).cast("long").alias("_to"))
    pin = ~F.col(action).isin("commit", "advance")
    rows = scans.cut(rows, [by], [order], "epochs")
    rows = scans.run(rows, [by], [order], {"_segment": scans.running_count(pin)})
    inside = [by, "_segment"]
    rows = scans.run(rows, inside, [order], {"_commits": scans.running_count(F.col(action) == "commit")})
    lead = F.when(pin | (F.col(action) == "advance"), F.col("_to") - F.col("_commits"))
    rows = scans.run(rows, inside, [order], {"_lead": scans.running_max(lead)})
    start = F.when(F.col("_segment") == 0, F.greatest(F.lit(0).cast("long"), "_lead")).otherwise(F.col("_lead"))
    rows = rows.withColumn("assigned", F.col("_commits") + start)
    rows = scans.run(rows, [by], [order], {"_before": scans.previous("assigned")})
    refused = (F.col(action) == "advance") & (F.col("_to") < F.coalesce("_before.assigned", F.lit(0)))
    return rows.select(by, order, action, "assigned", refused.alias("refused"))


def promoted(slots: DataFrame, slot: str, role: str, to_active: str) -> DataFrame:
    """Roles after ``to_active`` takes over: the old active slot becomes standby (the rollback slot)."""
    return slots.withColumn(role, F.when(F.col(slot) == to_active, "active").when(F.col(role) == "active", "standby").otherwise(F.col(role)))


def stale(log: DataFrame, epoch: int, token: int) -> DataFrame:
    return log.withColumn("stale", rules.is_stale_fence(F.col("epoch"), F.col("fence_token"), F.lit(epoch), F.lit(token)))
