"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by the order of its ``PREFIX`` nearest reference points
(pivots).  It lies in the inverted lists of its first pivots: at home in the list of
the nearest, a guest in the others.  A list compares its homes with all its members
by the number of pivots that two prefixes share; members with a partner of enough
shared pivots are shortlisted, and only their vectors are fetched and
compared by cosine.  A pair that meets in two lists is verified in one of them.

The vectors of many models lie in a narrow cone, so pivots may be as near to each
other as one and a half linking angles.  There the order of the nearest pivots changes
more between the vectors of a pair, so the number of lists (7 to 24) and of shared
pivots (12 to 1) is tuned on the sample, with a partner made at the threshold for each
vector.

Lists move ids and prefixes, never pairs: a long list is compared in tiles, spread
over tasks.  Homes within half the linking angle of their pivot all link with each
other by the triangle inequality, so such a core takes one count, not its square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

#: Pivots: the square root of the number of distinct vectors, within these bounds.
PIVOTS = (256, 2048)
PREFIX, LISTS, SHARED = 24, (7, 12, 16, 24), 12
#: The share of the pairs made at the threshold that the tuned numbers find where any do, and how many are made.
FOUND, MADE = 0.997, 4000
#: The pivots are chosen among about this many vectors a pivot, taken by hash; every vector is indexed.
SAMPLE = 8
#: Lists of more members are compared in tiles of about this many.
TILE = 2048
NARROW = 1e-9
#: Pivots less than so many linking angles apart would tell near copies apart that belong together.
APART = 1.5
HOME, CORE, GUEST = 0, 1, 2


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def choose_pivots(units: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Numbers of pivots, farthest first, at least ``APART`` linking angles apart, so that a group of near copies in the sample gives one."""
    if not len(units):
        return np.zeros(0, np.int64)
    chosen = [0]
    nearest = units @ units[0]
    most = math.cos(min(math.pi, APART * math.acos(max(-1.0, min(1.0, threshold)))))
    while len(chosen) < min(n, len(units)) and nearest.min() < most:
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, units @ units[chosen[-1]], out=nearest)
    return np.array(chosen)


def prefixes(units: np.ndarray, pivots: np.ndarray, k: int = PREFIX) -> np.ndarray:
    """Each vector's ``k`` nearest pivots, nearest first (-1 where there are fewer)."""
    out = np.full((len(units), k), -1, np.int16)
    have = min(k, len(pivots))
    if have:
        out[:, :have] = np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :have]
    return out


class Index:
    """Pivots for vectors of one length, fitted on a sample, and how many lists and shared pivots find pairs at the threshold."""

    def __init__(self, sample: np.ndarray, n_pivots: int, threshold: float):
        units = unit_rows(sample) if len(sample) else sample
        chosen = choose_pivots(units, n_pivots, threshold)
        self.pivots = units[chosen]
        self.lists, self.shared = max(1, min(LISTS[0], len(chosen))), min(SHARED, len(chosen))
        if len(chosen) > 1:
            self.tune(units, threshold)

    def describe(self, units: np.ndarray) -> np.ndarray:
        return prefixes(units, self.pivots)

    def tune(self, units: np.ndarray, threshold: float) -> None:
        rng = np.random.default_rng(0)
        x = units[rng.integers(len(units), size=MADE)]
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1)[:, None] * x
        near = np.sqrt((z * z).sum(1))[:, None]
        z = np.divide(z, near, out=np.zeros_like(z), where=near > NARROW)
        a, b = self.describe(x), self.describe(threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z)
        shared = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2).sum(1)
        for lists in LISTS:
            meet = (b[:, :lists] == a[:, :1]).any(1) | (a[:, :lists] == b[:, :1]).any(1)
            if meet.mean() >= FOUND or lists == LISTS[-1]:
                least = min(FOUND, meet.mean() - 0.001)
                self.lists = min(lists, len(self.pivots))
                self.shared = max(s for s in range(SHARED + 1) if (meet & (shared >= s)).mean() >= least)
                return


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of how many pivots the prefixes in ``a`` and ``b`` share."""
    used, where = np.unique(np.concatenate((a.ravel(), b.ravel())), return_inverse=True)
    marks = np.zeros((len(a) + len(b), len(used)), np.float32)
    marks[np.repeat(np.arange(len(marks)), a.shape[1]), where] = 1
    marks[:, used < 0] = 0
    return marks[: len(a)] @ marks[len(a) :].T


def _holds(prefix: np.ndarray, homes: np.ndarray, lists: int) -> np.ndarray:
    """[i, j]: whether homes[j] is among the first ``lists`` pivots of prefix i."""
    out = np.zeros((len(prefix), len(homes)), bool)
    for k in range(lists):
        out |= prefix[:, k, None] == homes[None, :]
    return out


def once(a: np.ndarray, b: np.ndarray, cell: int, lists: int) -> np.ndarray:
    """Which pairs are this list's to verify: of the lists of both nearest pivots, the first in number that holds both vectors."""
    home_a, home_b = a[:, 0], b[:, 0]
    if (home_a == cell).all() and (home_b == cell).all():
        return np.ones((len(a), len(b)), bool)
    at_a, at_b = _holds(b, home_a, lists).T, _holds(a, home_b, lists)
    none = np.iinfo(np.int16).max
    return np.minimum(np.where(at_a, home_a[:, None], none), np.where(at_b, home_b[None, :], none)) == cell


def cosine_at_least(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of which pairs reach the threshold; values within ``NARROW`` of it are summed again without rounding."""
    cosine = unit_rows(x) @ unit_rows(y).T
    hit = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < NARROW):
        exact = math.fsum(x[i] * y[j]) / math.sqrt(math.fsum(x[i] * x[i]) * math.fsum(y[j] * y[j]))
        hit[i, j] = exact >= threshold
    return hit


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _prefix_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1)


def _usable(embedding: str, label: str):
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


LIST = ["place", "size", "cell"]


def tiled(members: DataFrame) -> DataFrame:
    """Adds ``own``, ``one`` and ``two``: a row for each pair of tiles (one <= two) that the member takes part in.

    A list of up to ``TILE`` members is one tile.  In longer ones homes, cores and
    guests have tiles of their own; cores do not meet cores, nor guests guests.
    """
    n = members.groupBy(*LIST).agg(*[F.count_if(F.col("role") == r).alias(f"_{k}") for k, r in (("h", HOME), ("c", CORE), ("g", GUEST))])
    n = n.where((F.col("_h") + F.col("_c") + F.col("_g") > 1) & (F.col("_h") + F.col("_c") > 0))
    short = F.col("_h") + F.col("_c") + F.col("_g") <= TILE
    h, c, g = (F.ceil(F.col(x) / TILE).cast("int") for x in ("_h", "_c", "_g"))
    first = F.when(F.col("role") == HOME, 0).when(F.col("role") == CORE, F.col("_th")).otherwise(F.col("_th") + F.col("_tc"))
    of_role = F.when(F.col("role") == HOME, F.col("_th")).when(F.col("role") == CORE, F.col("_tc")).otherwise(F.col("_t") - F.col("_th") - F.col("_tc"))
    role_of = lambda t: F.when(t < F.col("_th"), HOME).when(t < F.col("_th") + F.col("_tc"), CORE).otherwise(GUEST)
    meets = lambda t: F.col("_short") | (F.col("role") == HOME) | (role_of(t) == HOME) | (role_of(t) != F.col("role"))
    sizes = n.select(*LIST, short.alias("_short"), F.when(short, 1).otherwise(h).alias("_th"), F.when(short, 0).otherwise(c).alias("_tc"), F.when(short, 1).otherwise(h + c + g).alias("_t"))
    own = F.when(F.col("_short"), 0).otherwise((first + F.pmod(F.xxhash64("class"), of_role)).cast("int"))
    out = members.join(sizes, LIST).withColumn("own", own)
    out = out.withColumn("_other", F.explode(F.filter(F.sequence(F.lit(0), F.col("_t") - 1), meets)))
    return out.withColumn("one", F.least("own", "_other")).withColumn("two", F.greatest("own", "_other")).drop("_other", "_short", "_th", "_tc", "_t")


def _sides(rows: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Row numbers of both tiles, roles, and whether both are one tile."""
    own, role = rows["own"].to_numpy(), rows["role"].to_numpy()
    low, high = rows["one"][0].as_py(), rows["two"][0].as_py()
    return np.flatnonzero(own == low), np.flatnonzero(own == high), role, low == high


def _comparable(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Pairs of roles with a home or core in them that are not both cores; each pair of one tile once."""
    ok = ((a != GUEST)[:, None] | (b != GUEST)[None, :]) & ~((a == CORE)[:, None] & (b == CORE)[None, :])
    return np.triu(ok, 1) if same else ok


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link if their labels are equal and not null, their vectors have the same
    length, and their cosine reaches ``threshold``.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing.  Exact copies are
    one class until the end, told apart by 128 bits of hash; labels that are no
    integers have lists by their 64-bit hash.  Rows with equal ids are rows of their
    own; a null id never names a component that has another id; an empty table gives
    no rows.  The index may miss links: see the README for the recall measured.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("usable", _usable("v", "label"))
    integral = isinstance(rows.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    place = F.col("label").cast("long") if integral else F.xxhash64("label")
    rows = rows.withColumn("place", place).withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    key = ["label", "h1", "h2"]
    classes = common.materialise(
        rows.where("usable").groupBy(*key).agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("place").alias("place"), F.first("v").alias("v"))
        .withColumn("size", F.size("v")).withColumn("class", F.monotonically_increasing_id()),
        "vector-classes",
    )
    total = classes.count()
    n_pivots = min(max(PIVOTS[0], math.isqrt(total)), PIVOTS[1])
    rate = min(1.0, SAMPLE * n_pivots / max(1, total))
    sample = sorted(tuple(r["v"]) for r in classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("v").collect())
    indexes = {n: Index(np.array([v for v in sample if len(v) == n], dtype=np.float64), n_pivots, threshold) for n in {len(v) for v in sample}}
    core_from = math.sqrt((1 + threshold) / 2) + 1e-9 if threshold > 0 else 2.0

    def describe(batches):
        for b in common.rows_of(batches, 4096):
            sizes = b.column("size").to_pylist()
            for n in set(sizes):
                part = b.filter(pa.array([s == n for s in sizes])) if len(set(sizes)) > 1 else b
                own = indexes.get(n) or Index(np.empty((0, n)), 0, threshold)
                units = unit_rows(_matrix(part.column("v")))
                prefix, m = own.describe(units), own.lists
                cell = prefix[:, :m].astype(np.int32)
                role = np.full(cell.shape, GUEST, np.int32)
                nearest = (units * own.pivots[prefix[:, 0]]).sum(1) if len(own.pivots) else np.full(len(units), -1.0)
                role[:, 0] = np.where(nearest >= core_from, CORE, HOME)
                packed = [p.tobytes() for p in prefix]
                wide = lambda c: np.repeat(part.column(c).to_numpy(zero_copy_only=False), m)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wide("class")), pa.array(wide("place")), pa.array(np.full(cell.size, n, np.int32)), pa.array(cell.ravel()), pa.array(role.ravel()), pa.array([p for p in packed for _ in range(m)], pa.binary())],
                    names=["class", *LIST, "role", "prefix"],
                )

    members = common.materialise(classes.select("class", "place", "size", "v").mapInArrow(describe, "class long, place long, size int, cell int, role int, prefix binary"), "pivot-lists")

    def shortlist(rows):
        left, right, role, same = _sides(rows)
        if not len(left) or not len(right):
            return
        prefix, classes_ = _prefix_matrix(rows["prefix"]), rows["class"].to_numpy()
        own = indexes.get(rows["size"][0].as_py())
        ok = (shared_counts(prefix[left], prefix[right]) >= (own.shared if own else 0)) & _comparable(role[left], role[right], same)
        hit = np.union1d(left[ok.any(1)], right[ok.any(0)])
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(classes_[hit]), *(pa.array(rows[c].to_numpy()[hit]) for c in (*LIST, "role")), rows["prefix"].take(pa.array(hit))], names=["class", *LIST, "role", "prefix"])

    pairs = [*LIST, "one", "two"]
    listed = components.by_group(tiled(members), pairs, shortlist, "class long, place long, size int, cell int, role int, prefix binary", common.partitions_of(members))
    visits = common.materialise(listed.groupBy("class", *LIST).agg(F.first("role").alias("role"), F.first("prefix").alias("prefix")), "pivot-shortlist")
    with_vectors = tiled(visits).join(classes.select("class", "copies", "v"), "class")

    def verify(rows):
        left, right, role, same = _sides(rows)
        if not len(left) or not len(right):
            return
        x, prefix = _matrix(rows["v"]), _prefix_matrix(rows["prefix"])
        ids, copies = rows["class"].to_numpy(), rows["copies"].to_numpy()
        hit = cosine_at_least(x[left], x[right], threshold) & _comparable(role[left], role[right], same)
        own = indexes.get(rows["size"][0].as_py())
        hit &= once(prefix[left], prefix[right], rows["cell"][0].as_py(), own.lists if own else 1)
        i, j = np.nonzero(hit)
        if not len(i):
            return
        i, j = left[i], right[j]
        count = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
        root = np.arange(len(x))
        while True:  # smallest row number over links, halving paths
            low_of = np.minimum(root[i], root[j])
            was = root.copy()
            np.minimum.at(root, root[i], low_of)
            np.minimum.at(root, root[j], low_of)
            np.minimum.at(root, i, low_of)
            np.minimum.at(root, j, low_of)
            root = root[root]
            if (root == was).all():
                break
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(ids[root[seen]]), pa.array(count[seen].astype(np.int64))], names=["class", "root", "links"])

    compared = components.by_group(with_vectors, pairs, verify, "class long, root long, links long", common.partitions_of(classes))
    cores = members.where(F.col("role") == CORE).select("class", *LIST).join(classes.select("class", "copies"), "class")
    together = cores.groupBy(*LIST).agg(F.sum("copies").alias("_all"), F.min("class").alias("root"))
    in_cores = cores.join(together, LIST).select("class", "root", (F.col("_all") - F.col("copies")).alias("links"))
    found = common.materialise(compared.unionByName(in_cores), "vector-links")
    common.discard(members, visits)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components.components(found.where(F.col("class") != F.col("root")).select("class", "root"), "class", "root")
    rooted = (
        classes.select("class", *key, "copies", "low")
        .join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
        .select(*key, "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    )
    rooted = common.materialise(rooted, "vector-roots")
    common.discard(classes, found)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = rooted.join(lowest, "root").select(*key, "n_links", "component_id")
    linked = rows.where("usable").select("vec_id", *key).join(of_class, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
