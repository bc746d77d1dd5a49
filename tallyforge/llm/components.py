"""Connected components by alternating large and small stars, and grouped processing of sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; root is the component's smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, below the
    smallest it sees, with minima and joins only, so a node of many links is never
    gathered.  The rounds grow with the logarithm of the longest path; each is
    written to the shared folder.  Null ends and self links are left out; an empty
    table gives no rows.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = common.materialise(edges, "stars-0")
    before = _signature(edges)
    for k in range(1, MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table of its own, so that AQE can split a node with very many neighbours.
        low_table = common.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"stars-low-{k}")
        large = both.where("v > u").join(low_table, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        was, edges = edges, common.materialise(small, f"stars-{k}")
        common.discard(was, low_table)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def by_group(df: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """``work`` on each group of rows with equal integer ``keys``; only for groups of bounded size.

    Rows are dealt by key and sorted, so a task holds one group at a time.
    ``work`` gets Arrow columns by name.
    """
    n = partitions or common.shuffle_partitions(df.sparkSession)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows):
            return work({c: rows.column(c) for c in rows.schema.names})

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            changed = np.zeros(b.num_rows, bool)
            for c in columns:
                changed[1:] |= c[1:] != c[:-1]
            if held:
                changed[0] = any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True))
            cuts = np.flatnonzero(changed).tolist()
            begin = 0
            for cut in cuts:
                if cut > begin:
                    held.append(b.slice(begin, cut - begin))
                if held:
                    yield from flush(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, begin = [], cut
            held.append(b.slice(begin))
        if held:
            yield from flush(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
