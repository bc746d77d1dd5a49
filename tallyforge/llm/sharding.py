"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

A group is all rows with equal text.  Groups go, largest share first, to the shard
whose residual capacity has the largest dot product with the group's load.  Groups
too small to matter singly are placed in bundles by hash of their digest, so the
driver places a bounded number of items whatever the corpus.

The law is that bytes come out nearly equal.  A group above a shard's fair share is
cut, as no whole placement could balance it, and so is any group of several rows
whose place keeps two shards apart by more than ``TOLERANCE``.  The plan gives each
shard a number of a cut group's rows, and rows take them by gapless rank, so parts
have exactly the planned sizes however ids repeat.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = ("bytes", "tokens", "rows")
#: Light groups share this many bundles.
BUNDLES = 1 << 14
#: Groups with more than 1 / (shards * HEAVY) of any total are placed singly: at most 3 * shards * HEAVY.
HEAVY = 64
#: Bytes count most, as the law of the result is that bytes come out nearly equal.
WEIGHTS = (4.0, 1.0, 1.0)
#: Shards further apart than this share of the mean cut groups that are whole so far.
TOLERANCE = 0.01


class Item(NamedTuple):
    """What is placed: ``rows`` rows of heavy group ``group``, or all of bundle ``bundle``."""

    group: int
    bundle: int
    rows: int


def place(loads: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item; ``loads`` has a row per item and a column per dimension."""
    shares = loads / np.maximum(loads.sum(0), 1)
    shares = shares * shards
    residual = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int64)
    scale = np.array(weights)
    for i in np.argsort(-(shares * scale).max(1), kind="stable"):
        item = shares[i]
        score = residual @ (item * scale)
        misfit = (residual < item - 1e-9) @ scale  # dimensions that would overflow come first
        best = int(np.lexsort((-score, misfit > 0))[0]) if (misfit == 0).any() else int(np.argmax(score))
        out[i] = best
        residual[best] -= item
    return level(loads[:, 0], out, shards)


def level(sizes: np.ndarray, placed: np.ndarray, shards: int) -> np.ndarray:
    """Evens out the first dimension: moves the item nearest to half the gap from the fullest shard to the emptiest until none narrows the gap.

    Sizes are whole numbers and each move lowers the sum of their squares, so it ends.
    """
    out = placed.copy()
    filled = np.bincount(out, weights=sizes, minlength=shards)
    while True:
        high, low = int(filled.argmax()), int(filled.argmin())
        gap = filled[high] - filled[low]
        mine = np.flatnonzero((out == high) & (sizes > 0) & (sizes < gap))
        if not len(mine):
            return out
        i = mine[np.abs(sizes[mine] - gap / 2).argmin()]
        out[i] = low
        filled[high] -= sizes[i]
        filled[low] += sizes[i]


def deal(quotas: np.ndarray, row_bytes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Evens out bytes by moving rows of heavy groups from the fullest shard to emptier ones until none narrows a gap (it ends for the same reason).

    ``quotas``: rows of each group (of ``row_bytes`` each) in each shard; ``rest``:
    the other bytes of each shard.  Groups that lie in several shards move first;
    whole ones are cut only beyond ``TOLERANCE``.
    """
    out = quotas.copy()
    filled = rest + row_bytes @ out if len(out) else rest.astype(np.float64).copy()
    whole_before = (out > 0).sum(1) == 1
    while len(out):
        high = int(filled.argmax())
        moved = False
        for low in np.argsort(filled, kind="stable").tolist():
            gap = filled[high] - filled[low]
            if gap <= 0:
                break
            far = gap > TOLERANCE * max(1.0, filled.mean())
            mine = np.flatnonzero((out[:, high] > 0) & (row_bytes < gap) & (~whole_before | (far & (out.sum(1) > 1))))
            if not len(mine):
                continue
            n = np.clip(np.rint(gap / 2 / row_bytes[mine]), 1, out[mine, high])
            best = int(np.lexsort((whole_before[mine], np.abs(gap - 2 * n * row_bytes[mine])))[0])
            i, k = mine[best], int(n[best])
            out[i, high] -= k
            out[i, low] += k
            filled[high] -= k * row_bytes[i]
            filled[low] += k * row_bytes[i]
            whole_before[i] = (out[i] > 0).sum() == 1
            moved = True
            break
        if not moved:
            break
    return out


def plan(heavy: list[tuple[float, ...]], light: list[tuple[float, ...]], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each heavy group in each shard, and the shard of each bundle; loads are (bytes, tokens, rows)."""
    total = np.maximum(np.array([*heavy, *light], dtype=np.float64).reshape(-1, len(DIMENSIONS)).sum(0), 1)
    items, loads = [], []
    for g, load in enumerate(heavy):
        rows = int(load[2])
        share = max(x / t for x, t in zip(load, total, strict=True)) * shards
        parts = min(rows, 1 if share <= 1 else int(np.ceil(share * 4)))
        for k in range(parts):
            n = rows // parts + (k < rows % parts)
            items.append(Item(g, -1, n))
            loads.append([x / rows * n for x in load])
    for b, load in enumerate(light):
        items.append(Item(-1, b, 0))
        loads.append(list(load))
    loads = np.array(loads, dtype=np.float64).reshape(-1, len(DIMENSIONS))
    shard = place(loads, shards)
    quotas, bundles, rest = np.zeros((len(heavy), shards), np.int64), np.zeros(len(light), np.int64), np.zeros(shards)
    for x, load, s in zip(items, loads, shard.tolist(), strict=True):
        if x.group >= 0:
            quotas[x.group, s] += x.rows
        else:
            bundles[x.bundle] = s
            rest[s] += load[0]
    return deal(quotas, np.array([h[0] / h[2] for h in heavy]), rest), bundles


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    size: UTF-8 bytes of the text plus 1 (null: 1).  Tokens are runs of characters
    that are not white space.  Null and empty texts are one group.  Rows with equal
    ids, and equal rows, are rows of their own; an empty table gives no rows; extra
    columns are not read.  A single row larger than a fair share stays whole.
    """
    text = common.text_of(text_col)
    data = F.encode(text, "utf-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.sha2(data, 256).alias("digest"),
        F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("row"),
    )
    rows = common.materialise(rows, "shard-rows")
    totals = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = groups.withColumn("share", F.greatest(*[F.col(d) / F.lit(float(max(1, t))) for d, t in zip(DIMENSIONS, totals, strict=True)]))
    groups = common.materialise(groups.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int")), "shard-groups")
    heavy = sorted(groups.where(F.col("share") > 1.0 / (shards * HEAVY)).collect(), key=lambda r: r["digest"])  # at most 3 * shards * HEAVY
    light = groups.where(F.col("share") <= 1.0 / (shards * HEAVY)).groupBy("bundle").agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
    light = sorted(light.collect(), key=lambda r: r["bundle"])  # at most BUNDLES
    common.discard(groups)
    quotas, bundles = plan([tuple(r[d] for d in DIMENSIONS) for r in heavy], [tuple(r[d] for d in DIMENSIONS) for r in light], shards)

    whole, cut = [], []
    for r, quota in zip(heavy, quotas.tolist(), strict=True):
        held = [(s, n) for s, n in enumerate(quota) if n]
        if len(held) == 1:
            whole.append((r["digest"], held[0][0]))
        else:
            at = 0
            for s, n in held:
                cut.append((r["digest"], at, at + n, s))
                at += n
    spark = docs.sparkSession
    single = spark.createDataFrame(whole, "_digest string, _single int")
    bundled = spark.createDataFrame([(r["bundle"], s) for r, s in zip(light, bundles.tolist(), strict=True)], "_bundle int, _shared int")
    parts = spark.createDataFrame(cut, "_digest string, _from long, _to long, shard int")  # at most a row for each heavy group and shard
    kept = ["doc_id", "size", "text_crc32", "row", "shard"]
    divided = F.broadcast(parts.select("_digest").distinct())
    placed = (
        rows.join(divided, F.col("digest") == F.col("_digest"), "left_anti")
        .withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int"))
        .join(F.broadcast(single), F.col("digest") == F.col("_digest"), "left")
        .join(F.broadcast(bundled), F.col("bundle") == F.col("_bundle"), "left")
        .select(*kept[:-1], F.coalesce("_single", "_shared").alias("shard"))
    )
    if cut:
        ranked = common.materialise(rows.join(divided, F.col("digest") == F.col("_digest"), "left_semi"), "shard-divided")
        ranked = common.rank_within(ranked, "digest", ["doc_id", "row"], "rank")
        within = (F.col("digest") == F.col("_digest")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
        placed = placed.unionByName(ranked.join(F.broadcast(parts), within).select(*kept))
    return common.rank_within(common.materialise(placed, "shard-placed"), "shard", ["doc_id", "text_crc32", "row"], "slot").drop("row")
