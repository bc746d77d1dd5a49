"""Approximate nearest neighbours by inner product, with one vantage-point tree a shard.

Trees are built over angles, which obey the triangle inequality: a part of the tree
whose angles to a vantage point lie between lo and hi has no vector nearer to a query
at angle d than t = max(d - hi, lo - d).  With the norms of the part that bounds its
inner products by |q| |x| cos(t), whatever the norms of other vectors.  Leaves are
searched from the largest bound on, and a query is done once its bound is below its
k-th best product.  Pruning takes ``factor`` times t: one gives the exact result,
larger factors skip more and may miss some.

Vectors are dealt to shards of bounded size by row number, whatever they hold, and
each shard becomes one row of the index.  Queries go in blocks: a block meets the
shards of a lane one after the other in one task and takes its best so far along, so
what is emitted grows with the queries alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, components

#: Vectors of a shard, of a leaf of its tree, and queries of a block, at most.
SHARD, LEAF, BLOCK = 4096, 64, 2048
#: Lanes of a block of queries: tasks that share its shards.
LANES = 8
#: How many best vectors a query keeps beyond those asked for, so that ties are told apart exactly.
SPARE = 12
#: Default relaxation of the pruning; see the README for the recall measured.
FACTOR = 2.0
#: Points that are tried as vantage points of a node, and points that they are judged by.
TRIED, JUDGES = 4, 64
CLOSE = 1e-9


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component from the first on, so that equal rows give equal values wherever they stand."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for k in range(x.shape[-1]):
        out += x[..., k] * y[..., k]
    return out


def angles(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ point, -1.0, 1.0))


def build(vectors: np.ndarray, ids: np.ndarray, k: int, seed: int) -> dict[str, np.ndarray]:
    """A shard's tree: distinct vectors in leaf order with their ``k`` + 1 smallest ids each, leaf bounds and norms, vantage points, and each half's span of angles.

    Nodes split at the median angle, so the tree is balanced whatever repeats.
    """
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(1)
    first = np.flatnonzero(new)
    copies = np.diff(np.append(first, len(ids)))
    x = vectors[first]
    n = len(x)
    norms = np.sqrt((x * x).sum(1))
    units = x / norms[:, None]
    depth = max(0, int(np.ceil(np.log2(max(1.0, n / LEAF)))))
    rng = np.random.default_rng(seed)
    place, bounds = np.arange(n), np.array([0, n])
    vantage, spans = np.zeros((1 << depth) - 1, np.int64), np.zeros(((1 << depth) - 1, 2, 2))
    for level in range(depth):
        cuts = [0]
        for node in range(1 << level):
            own = place[bounds[node] : bounds[node + 1]]
            tried = rng.choice(own, min(TRIED, len(own)), replace=False)
            judges = rng.choice(own, min(JUDGES, len(own)), replace=False)
            at = (1 << level) - 1 + node
            vantage[at] = tried[int(angles(units[tried], units[judges].T).std(1).argmax())]
            d = angles(units[own], units[vantage[at]])
            half = len(own) // 2
            split = np.argpartition(d, half - 1) if half else np.arange(len(own))
            place[bounds[node] : bounds[node + 1]], d = own[split], d[split]
            spans[at] = [[d[:half].min(initial=np.inf), d[:half].max(initial=-np.inf)], [d[half:].min(initial=np.inf), d[half:].max(initial=-np.inf)]]
            cuts += [bounds[node] + half, bounds[node + 1]]
        bounds = np.array(cuts)
    kept = np.minimum(copies, k + 1)[place]
    flat = np.repeat(first[place], kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    leaves = [norms[place[a:b]] for a, b in zip(bounds, bounds[1:])]
    reach = np.array([[own.min(initial=np.inf), own.max(initial=0.0)] for own in leaves])
    return {"x": x[place], "bounds": bounds, "norms": reach, "points": units[vantage], "spans": spans, "ids": ids[flat], "n_ids": kept}


def leaf_bounds(tree: dict[str, np.ndarray], q: np.ndarray, factor: float) -> np.ndarray:
    """[query, leaf]: no vector of the leaf has a larger product with the query, by the spans of all nodes above it and its norms (if ``factor`` is one)."""
    length = np.sqrt((q * q).sum(1))
    away = np.zeros((len(q), 1))
    d = angles(q / length[:, None], tree["points"].T)
    for level in range(int(np.log2(len(tree["points"]) + 1))):
        nodes = slice((1 << level) - 1, (2 << level) - 1)
        span = tree["spans"][nodes].reshape(-1, 2)  # the halves of the nodes in order
        near = np.repeat(d[:, nodes], 2, axis=1)
        away = np.maximum(np.repeat(away, 2, axis=1), np.maximum(near - span[:, 1], span[:, 0] - near))
    cosine = np.cos(np.minimum(np.pi, factor * np.maximum(0.0, away - 1e-6)))  # angles near zero are not exact
    return length[:, None] * np.where(cosine > 0, tree["norms"][:, 1], tree["norms"][:, 0]) * cosine


class Best:
    """The best vectors found so far for each query of a block: numbers in ``x`` and ``ids`` with exact products."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.width = q, k, k + 1 + SPARE
        self.score = np.full((len(q), self.width), -np.inf)
        self.x = np.zeros((0, q.shape[1]))
        self.ids: list[np.ndarray] = []
        self.at = np.full((len(q), self.width), -1)
        self.compared = 0

    def search(self, tree: dict[str, np.ndarray], factor: float) -> None:
        q, x, bounds = self.q, tree["x"], tree["bounds"]
        if not len(x) or not len(q):
            return
        base = len(self.ids)
        high = leaf_bounds(tree, q, factor)
        order = np.argsort(-high, axis=1)
        score, at = self.score.copy(), self.at.copy()
        left = np.arange(len(q))
        for r in range(high.shape[1]):
            leaf = order[left, r]
            worst = score[left, self.k]  # minus infinity: not yet full
            go = high[left, leaf] >= worst - CLOSE * np.abs(np.maximum(worst, -1e300))
            left, leaf = left[go], leaf[go]
            if not len(left):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for own in np.split(left[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                one = order[own[0], r]
                a, b = bounds[one], bounds[one + 1]
                self.compared += len(own) * int(b - a)
                both = np.hstack((score[own], q[own] @ x[a:b].T))
                names = np.hstack((at[own], np.broadcast_to(np.arange(base + a, base + b), (len(own), b - a))))
                top = np.argpartition(-both, self.width - 1, axis=1)[:, : self.width]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1), 1)
                score[own], at[own] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        ids = np.split(tree["ids"], np.cumsum(tree["n_ids"])[:-1])
        self.settle(score, at, x, ids)

    def settle(self, score: np.ndarray, at: np.ndarray, x: np.ndarray, ids: list[np.ndarray]) -> None:
        """Exact products of what was found, ordered by product and smallest id; where ties may go beyond the kept width the shard is compared exactly."""
        base, all_x, all_ids = len(self.ids), np.vstack((self.x, x)), self.ids + ids
        lowest = np.array([i[0] for i in all_ids])
        full = score[:, -1] > -np.inf
        tied = np.flatnonzero(full & (score[:, self.k] - np.where(full, score[:, -1], 0.0) <= CLOSE * np.abs(score[:, self.k]) + 1e-300))
        for part in np.array_split(np.arange(len(score)), max(1, score.size * x.shape[1] >> 22)):
            exact = products(self.q[part, None, :], all_x[at[part]])
            exact[at[part] < 0] = -np.inf
            first = np.lexsort((lowest[at[part]], -exact), axis=1)
            score[part], at[part] = np.take_along_axis(exact, first, 1), np.take_along_axis(at[part], first, 1)
        for i in tied.tolist():
            names = np.union1d(self.at[i][self.at[i] >= 0], np.arange(base, len(all_ids)))
            exact = products(self.q[i], all_x[names])
            first = np.lexsort((lowest[names], -exact))[: self.width]
            score[i, : len(first)], at[i, : len(first)] = exact[first], names[first]
        used = np.unique(at[at >= 0])
        self.x, self.ids = all_x[used], [all_ids[u] for u in used.tolist()]
        self.score, self.at = score, np.where(at >= 0, np.searchsorted(used, at), -1)

    def rows(self, own_ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(query number, id, product): the best ``k`` rows of each query but those with its own id."""
        for i, own in enumerate(own_ids.tolist()):
            found = [(-s, v, s) for s, a in zip(self.score[i].tolist(), self.at[i].tolist()) if a >= 0 for v in self.ids[a].tolist() if v != own]
            found.sort(key=lambda t: t[:2])
            for _, v, s in found[: self.k]:
                yield i, v, s


def usable(vector: str, vec_id: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(numbers: dict[int, int]) -> Column:
    """The number of the row's length of vectors (column dim), as a column."""
    return F.element_at(F.create_map(*[F.lit(x) for d, n in (numbers or {0: 1}).items() for x in (d, n)]), F.col("dim"))


def build_index(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """The index as a written table (dim, shard, tree), the numbered usable rows as another, and the number of shards by length of vectors.

    Every usable row is in one tree.  Shards are dealt by row number, so no value and no repeated id fills one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable("v", "vec_id"))
    rows = common.materialise(rows.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")), "vantage-rows")
    shards = {r.dim: -(-r.n // SHARD) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a length of vectors

    def trees(group):
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        made = build(_matrix(group["v"]), group["vec_id"].to_numpy(), k, shard)
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int64()), pa.array([pack(**made)], pa.binary())], names=["dim", "shard", "tree"])

    dealt = rows.select("vec_id", "v", "dim", F.pmod("row", by_length(shards)).alias("shard"))
    index = components.by_group(dealt, ["dim", "shard"], trees, "dim int, shard long, tree binary", common.partitions_of(rows))
    return common.materialise(index, "vantage-trees"), rows, shards


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``queries`` selects, the ``k`` other rows found with the largest inner products.

    Products are summed in double precision, component by component; ties go to the
    smaller id.  ``queries`` sees columns vec_id and v.  Rows whose id or vector is
    null, or whose vector is zero, empty or holds null or non-finite components, take
    no part; vectors meet those of their own length.  Rows with equal ids are rows of
    their own: each is a query and a candidate, but none with the query's id is
    returned.  Where fewer candidates exist all of them are returned; extra columns
    are not read; an empty table gives no rows.
    """
    if factor < 1:
        raise ValueError("the factor must be at least one")
    index, rows, shards_of = build_index(vectors, k, id_col, vector_col)
    asked = common.materialise(rows.where(queries).select("vec_id", "v", "dim"), "vantage-queries")
    sizes = {r.dim: -(-r.n // BLOCK) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        common.discard(index, rows, asked)
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lanes = by_length({d: min(LANES, shards_of[d]) for d in sizes})

    def blocks(group):
        dim, block = group["dim"][0].as_py(), group["block"][0].as_py()
        data = pack(q=_matrix(group["v"]), ids=group["vec_id"].to_numpy(), rows=group["row"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["dim", "block", "data"])

    numbered = asked.withColumn("row", F.monotonically_increasing_id())
    packed = components.by_group(numbered.withColumn("block", F.pmod("row", by_length(sizes)).cast("long")), ["dim", "block"], blocks, "dim int, block long, data binary")
    sides = packed.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1))).select("dim", "block", "lane", F.lit(-1).cast("long").alias("shard"), "data")
    shards = index.where(F.col("dim").isin(*sizes)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), by_length(sizes) - 1)))
    meet = sides.unionByName(shards.select("dim", "block", F.pmod("shard", lanes).alias("lane"), "shard", F.col("tree").alias("data")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = ids = numbers = None

        def done():
            found = list(best.rows(ids))
            at = np.array([i for i, _, _ in found], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(ids[at]), pa.array([v for _, v, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["row", "query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                shard, data = b.column(3)[i].as_py(), unpack(b.column(4)[i].as_py())
                if shard < 0:
                    if best is not None:
                        yield done()
                    best, ids, numbers = Best(data["q"], k), data["ids"], data["rows"]
                else:
                    best.search(data, factor)
        if best is not None:
            yield done()

    tasks = max(common.shuffle_partitions(vectors.sparkSession), sum(n * min(LANES, shards_of[d]) for d, n in sizes.items()))
    met = meet.repartition(tasks, "dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "shard")
    found = common.materialise(met.mapInArrow(search, "row long, query_id long, vec_id long, score double"), "vantage-found")
    common.discard(index, rows, asked)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
