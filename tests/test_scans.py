"""Segmented scans: running values of long histories, cut into pieces, against folds in order."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import catalog, log_ops, scans, series


@pytest.fixture
def many_pieces(spark):
    """Small tables stay in as many pieces as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_folds(spark, many_pieces, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "a", "a", "a", "b"]), t, rng.choice([None, *range(-5, 9)])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v int").repartition(5)
    columns = {
        "total": scans.running_sum(F.col("v")), "sum_before": scans.running_sum(F.col("v"), before=True), "top": scans.running_max(F.col("v")),
        "top_before": scans.running_max(F.col("v"), before=True), "newest": scans.last_value(F.col("v")), "prev": scans.previous("v"), "big": scans.running_count(F.col("v") > 3),
    }
    cut = scans.cut(df, ["k"], ["t"])
    assert cut.where("k = 'a'").select(scans.PIECE).distinct().count() > 3  # the long history lies in several pieces
    got = {(r.k, r.t): r for r in scans.plain(scans.run(cut, ["k"], ["t"], columns)).collect()}
    assert len(got) == len(rows) and scans.scan(df, ["k"], ["t"], columns).columns == [*df.columns, *columns]
    seen = {}
    for k, t, v in rows:
        old = [x for x in seen.get(k, []) if x is not None]
        new = old if v is None else [*old, v]
        want = (sum(new), sum(old), max(new, default=None), max(old, default=None), new[-1] if new else None, sum(x > 3 for x in new))
        r = got[k, t]
        assert (r.total, r.sum_before, r.top, r.top_before, r.newest, r.big) == want
        assert r.prev is None if k not in seen else r.prev.v == seen[k][-1]
        seen.setdefault(k, []).append(v)


def test_no_task_gets_a_whole_key(spark, many_pieces):
    n = 1_000_000
    log = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), (F.col("id") % 1000 + F.floor(F.col("id") / 300_000) * 1000).alias("fence_token"))
    cut = scans.cut(log, ["k"], ["seq"])
    sizes = [r["count"] for r in cut.groupBy(scans.PIECE).count().collect()]
    assert sum(sizes) == n and max(sizes) < 2 * n / int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = scans.run(cut, ["k"], ["seq"], {"x": scans.running_count(F.lit(True))})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(scans.PIECE in line for line in windows)
    seq = np.arange(n)
    token = seq % 1000 + seq // 300_000 * 1000
    held = np.concatenate(([0], np.maximum.accumulate(token)[:-1]))
    got = log_ops.stale_fences(log, ["k"]).agg(F.sum("held").alias("held"), F.count_if("stale").alias("stale")).first()
    assert (got.held, got.stale) == (held.sum(), ((held > 0) & (token > 0) & (token < held)).sum())


def test_equal_orders_are_cut_too(spark, many_pieces):
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.lit(7).alias("t"), F.col("id"))
    cut = scans.cut(df, ["k"], ["t"])
    assert cut.select(scans.PIECE).distinct().count() > 3
    got = scans.run(cut, ["k"], ["t"], {"n": scans.running_count(F.lit(True))})
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (40_000, 1, 40_000)


def test_histories_in_pieces(spark, many_pieces):
    rng = random.Random(9)
    base = datetime(2024, 1, 1)
    actions = [(0, k, rng.choice(["commit", "commit", "advance", "rollback", "force"]), rng.randrange(40)) for k in range(600)]
    now, want = 0, {}
    for _, at, what, to in actions:
        refused = what == "advance" and to < now
        now = now + 1 if what == "commit" else now if refused else to
        want[at] = now, refused
    got = log_ops.epochs(spark.createDataFrame(actions, "d int, at long, what string, e long"), "d", "at", "what", "e").collect()
    assert {r.at: (r.assigned, r.refused) for r in got} == want

    samples = spark.createDataFrame([("x", base + timedelta(seconds=10 * t), (t * 37) % 101, 2.0, 3.0) for t in range(500)], "k string, at timestamp, backlog long, w double, r double")
    got = {r.at: (r.velocity, r.improving) for r in series.convergence(samples, ["k"], "at", "backlog", "w", "r").collect()}
    for t in range(500):
        moved = (t * 37) % 101 - ((t - 1) * 37) % 101 if t else 0
        assert got[base + timedelta(seconds=10 * t)] == (moved / 10, moved < 0)

    points = spark.createDataFrame([("a", e, rng.randrange(1000), f"p{e}") for e in range(0, 900, 3)], "k string, epoch long, made long, id string")
    asked = spark.createDataFrame([("a", w) for w in range(-2, 900, 7)], "k string, wanted long")
    rows = points.collect()
    for r in catalog.as_of(points, ["k"], asked, "epoch", "made", "wanted").collect():
        best = max((p for p in rows if p.epoch <= r.wanted), key=lambda p: (p.made, p.epoch), default=None)
        assert r.id == (best.id if best else None)


@pytest.mark.parametrize("bound", [0, 50, 10**6])
def test_only_long_histories_are_cut(spark, many_pieces, monkeypatch, bound):
    """Short, long and null keys give a fold's values, and histories within the bound take no pieces."""
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "a", "a", "b", "c"]), t, rng.choice([None, *range(9)])) for t in range(300)]
    cuts, plain = [], scans.cut

    def counted(df, *rest):
        out = plain(df, *rest)
        cuts.append(out.count())
        return out

    monkeypatch.setattr(scans, "cut", counted)
    monkeypatch.setattr(scans, "WHOLE", bound)
    columns = {"total": scans.running_sum(F.col("v"), before=True), "top": scans.running_max(F.col("v")), "newest": scans.last_value(F.col("v"), before=True)}
    got = {(r.k, r.t): r for r in scans.scan(spark.createDataFrame(rows, "k string, t long, v int").repartition(5), ["k"], ["t"], columns).collect()}
    sizes = {k: sum(x[0] == k for x in rows) for k, _, _ in rows}
    assert sum(cuts) == sum(n for n in sizes.values() if n > bound) and len(got) == len(rows)
    seen = {}
    for k, t, v in rows:
        old = seen.setdefault(k, [])
        assert (got[k, t].total, got[k, t].newest) == (sum(old), old[-1] if old else None)
        old += [] if v is None else [v]
        assert got[k, t].top == max(old, default=None)
