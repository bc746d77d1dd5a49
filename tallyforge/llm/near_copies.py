"""Near copies: an exact join of texts whose sets of five-word shingles reach a Jaccard similarity of 0.8.

Shingles are compared as the 64-bit hashes that also make the SimHash fingerprints.
All sets are ordered alike, rare shingles first.  A pair at 0.8 shares one of the
first n - ceil(0.8 n) + 1 shingles of both sets (their prefixes), so texts meet by
those, and the place where they first do bounds how many they can share at all.  Any
fixed order is right.  The better it tells rare from frequent, the fewer texts meet:
a passage that many documents hold comes last and brings none of them together
unless it fills most of them, and shingles that one text alone holds are no keys.

The order comes from a bitmap of two bits a cell, of bounded size: whether a cell's
shingles occur in one text, up to 8, up to 64, or more.  Every pair that may be similar
is verified by whole sets, so nothing is lost or linked by chance.

Equal sets are one class.  The first pairs are op10's: classes whose SimHash fingerprints
differ in at most 3 bits, found by pigeonring chains and then verified by whole sets.
Pairs at 0.8 that lie further apart come by the prefixes: buckets of up to ``LONG`` texts
first pair along a forest, longer ones (large groups of near copies) with the text whose
fingerprint is in their middle; a second round compares what is still in different
components, in long buckets by whole sets on the spot.  So no large group gives all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components, simhash

WORDS = 5
#: Buckets up to ``SHORT`` texts give all pairs that pass at once; beyond ``LONG`` they are compared in tiles of about so many texts and shingles.
SHORT, LONG, TILE, TILE_SHINGLES = 8, 64, 1024, 1 << 19
#: The bitmap has at most 2 ** this many cells (16 MB), and counts are cut into parts of about this many bytes of text.
CELL_BITS, PART_BYTES = 26, 1 << 22
#: Up to so many texts a shingle is of the first levels; shingles of one text are of level 0.
LEVELS = (8, 64)
#: Shingles that a task counts at once, and sets that it remembers so as to count equal ones once.
COUNTED, REMEMBERED = 1 << 20, 1 << 16


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, WORDS))


def similar(shared, sizes):
    """Jaccard similarity of at least 0.8 for sets of ``shared`` elements in common and ``sizes`` in sum."""
    return 9 * shared >= 4 * sizes


def prefix_length(n: int) -> int:
    """Of a set of n shingles: any set that is similar shares one of so many first ones."""
    return n - -(-4 * n // 5) + 1 if n else 0


def may_link(size: np.ndarray, rest: np.ndarray, other_size: np.ndarray, other_rest: np.ndarray) -> np.ndarray:
    """Which pairs sizes allow, and the shingles from the first shared one on (``rest`` of them)."""
    low, high = np.minimum(size, other_size), np.maximum(size, other_size)
    return (5 * low >= 4 * high) & (9 * np.minimum(rest, other_rest) >= 4 * (low + high))


def may_link_sql(size: str, rest: str, other_size: str, other_rest: str) -> Column:
    """``may_link`` as a column."""
    low, high = F.least(size, other_size), F.greatest(size, other_size)
    return (5 * low >= 4 * high) & (9 * F.least(rest, other_rest) >= 4 * (low + high))


_MARKS = "row long, id long, class binary, size int, fp long, part int, cells binary"


def marks(rows: DataFrame, row_col: str, id_col: str, text_col: str, part_bits: int) -> DataFrame:
    """Rows of two kinds from one reading of the texts: row, id, class (the hash of the shingle set), size and fp of each text; and part, cells for counting.

    ``cells`` holds the 32 bits after the first ``part_bits`` of each shingle, of texts
    whose sets a task has not seen lately.  Null text has no shingles.
    """

    def cut(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(sets)
        sets.clear()  # one copy of the hashes at a time
        every.sort()
        part = (every >> np.uint64(64 - part_bits)).astype(np.int32)
        begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        part = part[begins]
        every <<= np.uint64(part_bits)
        every >>= np.uint64(32)
        cells = every.astype("<u4")
        blobs = [x.tobytes() for x in np.split(cells, begins[1:])]
        none = [pa.nulls(len(begins), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(part), pa.array(blobs, pa.binary())], names=["row", "id", "class", "size", "fp", "part", "cells"])

    def mark(batches):
        held, n, known = [], 0, set()
        for b in common.rows_of(batches):
            sets = [shingle_set(x) for x in common.texts_as_bytes(b.column(2))]
            same = [xxhash.xxh3_128_digest(x.tobytes(), simhash.SEED) for x in sets]
            fps = np.array([simhash.of_hashes(x) for x in sets], np.uint64).view(np.int64)
            none = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps), *none], names=["row", "id", "class", "size", "fp", "part", "cells"])
            if len(known) > REMEMBERED:
                known.clear()
            for x, digest in zip(sets, same, strict=True):
                if digest not in known and len(x):
                    known.add(digest)
                    held.append(x)
                    n += len(x)
            if n >= COUNTED:
                yield from cut(held)
                held, n = [], 0
        if held:
            yield from cut(held)

    chosen = rows.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(mark, _MARKS)


class Rarity:
    """How frequent shingles are, in four levels, by the first bits of their hashes."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        cell = shingles >> np.uint64(64 - self.bits)
        return (self.packed[cell >> np.uint64(2)] >> (2 * (cell & np.uint64(3))).astype(np.uint8)) & 3

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of a set's prefix that other texts may hold too, and how many shingles follow from each on."""
        level = self(shingles)
        order = np.argsort(level, kind="stable")[: prefix_length(len(shingles))]  # by level, then hash
        at = np.flatnonzero(level[order] > 0)
        return shingles[order[at]], (len(shingles) - at).astype(np.int32)


def rarity(marked: DataFrame, part_bits: int, bits: int) -> Rarity:
    """Levels of all cells, counted over all rows of ``marks``; a part of the counts is one group, and gives the driver two bits a cell."""

    def count(group):
        values = np.sort(np.frombuffer(b"".join(group["cells"].to_pylist()), "<u4"))
        begins = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        n = np.diff(np.append(begins, len(values)))
        level = (n > 1).astype(np.uint8) + (n > LEVELS[0]) + (n > LEVELS[1])
        out = np.zeros(1 << (bits - part_bits), np.uint8)
        np.maximum.at(out, values[begins] >> np.uint32(32 - (bits - part_bits)), level)
        four = out.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
        yield pa.RecordBatch.from_arrays([group["part"].slice(0, 1), pa.array([four.sum(1, dtype=np.uint8).tobytes()], pa.binary())], names=["part", "levels"])

    packed = np.zeros((1 << part_bits, 1 << (bits - part_bits - 2)), np.uint8)
    parts = marked.where(F.col("part").isNotNull()).select("part", "cells")
    for r in components.by_group(parts, ["part"], count, "part int, levels binary", common.partitions_of(marked)).toLocalIterator():
        packed[r.part] = np.frombuffer(r.levels, np.uint8)
    return Rarity(bits, packed.ravel())


def prefixes(rows: DataFrame, row_col: str, text_col: str, order: Rarity) -> DataFrame:
    """row, keys and rests of the texts that have any key."""

    def cut(batches):
        for b in common.rows_of(batches):
            found = [order.prefix(shingle_set(x)) for x in common.texts_as_bytes(b.column(1))]
            some = [i for i, (x, _) in enumerate(found) if len(x)]
            if some:
                ends = pa.array(np.cumsum([0, *(len(found[i][0]) for i in some)]), pa.int32())
                keys, rests = (np.concatenate([found[i][k] for i in some]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(rests))], names=["row", "keys", "rests"])

    chosen = rows.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(cut, "row long, keys array<long>, rests array<int>")


def bucket_pairs(key: np.ndarray, row: np.ndarray, size: np.ndarray, rest: np.ndarray, root: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in buckets (rows sorted by key).

    First round (no roots): all that may link in buckets up to ``SHORT``, a forest of
    them in longer ones.  Second: those of longer ones in different components.
    """
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(begins, len(key)))
    if root is None:
        few = np.repeat(n <= SHORT, n)
        for step in range(1, SHORT):
            i = np.flatnonzero(few[step:] & (key[step:] == key[:-step]))
            i = i[may_link(size[i], rest[i], size[i + step], rest[i + step])]
            yield row[i], row[i + step]
    for at, end in zip(begins[n > SHORT].tolist(), (begins + n)[n > SHORT].tolist(), strict=True):
        if root is None:
            left = np.arange(at, end)
            while len(left) > 1:
                front, left = [left[0]], left[1:]
                while front and len(left):
                    x = front.pop()
                    hit = may_link(size[left], rest[left], size[x], rest[x])
                    if hit.any():
                        yield np.full(hit.sum(), row[x]), row[left[hit]]
                        front += left[hit].tolist()
                        left = left[~hit]
        else:
            s, f, r = size[at:end], rest[at:end], root[at:end]
            if (r == r[0]).all():
                continue
            i, j = np.nonzero(np.triu(may_link(s[:, None], f[:, None], s[None, :], f[None, :]) & (r[:, None] != r[None, :]), 1))
            yield row[at:end][i], row[at:end][j]


_PAIRS = "a long, b long"


def _batch(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        x, y = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def in_buckets(listed: DataFrame, partitions: int) -> DataFrame:
    """``bucket_pairs`` over buckets of bounded size: (key, row, size, rest) and, in the second round, root."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def arrays(table):
            out = [table.column(c).to_numpy() for c in table.schema.names]
            return [out[0], out[1], out[2].astype(np.int64), out[3].astype(np.int64), out[4] if len(out) > 4 else None]

        def flush(last):
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            held.clear()
            if cut < len(keys):
                held.extend(table.slice(cut).to_batches())
            if cut:
                yield from _batch(list(bucket_pairs(*arrays(table.slice(0, cut)))))

        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= 1 << 16:
                    yield from flush(False)
                    n = sum(x.num_rows for x in held)
        if held:
            yield from flush(True)

    return listed.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, _PAIRS)


def shingle_sets(wanted: DataFrame, rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """row, shingles of the wanted rows (a written table, so that a small one is broadcast and no text is shuffled)."""

    def cut(batches):
        for b in common.rows_of(batches, 64):
            sets = [shingle_set(x) for x in common.texts_as_bytes(b.column(1))]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["row", "shingles"])

    chosen = rows.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("t")).join(wanted.select("row"), "row", "left_semi")
    return chosen.mapInArrow(cut, "row long, shingles array<long>")


def verified(pairs: DataFrame, rows: DataFrame, row_col: str, text_col: str, name: str) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets are similar; ``pairs`` is a written table."""
    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    ends = common.materialise(ends, f"near-ends-{name}")
    sets = common.materialise(shingle_sets(ends, rows, row_col, text_col), f"near-sets-{name}")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    out = common.materialise(both.where(similar(F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y"))).select("a", "b"), f"near-links-{name}")
    common.discard(ends, sets)
    return out


def set_links(size: np.ndarray, root: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """A forest of the links between texts of ``left`` and ``right`` (numbers) in different components, by their whole sets.

    Each set is a row of bits over the shingles that at least two of them hold.
    """
    _, where, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    bits = np.zeros((len(sets), max(1, -(-int((held > 1).sum()) // 64))), np.uint64)
    shared = held[where] > 1
    of, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[shared], number[where[shared]]
    np.bitwise_or.at(bits, (of, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    root, one = root.copy(), left is right
    for n, i in enumerate(left.tolist()):
        j = right[n + 1 :] if one else right
        j = j[(root[j] != root[i]) & may_link(size[j], size[j], size[i], size[i])]
        for part in np.array_split(j, max(1, len(j) * bits.shape[1] >> 20)):
            both = np.bitwise_count(bits[part] & bits[i]).sum(1, dtype=np.int64)
            for k in part[similar(both, size[part].astype(np.int64) + int(size[i]))].tolist():
                if root[k] != root[i]:
                    yield i, k
                    root[root == root[k]] = root[i]


def in_tiles(left: DataFrame, rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """Links between components in long buckets, found by whole sets where the texts meet; ``left`` has key, row, size and root.

    Texts that share a bucket, if only through others, are one group, so that a text
    goes there once and not with each of its keys.  Large groups are compared in
    tiles, and a task gives a forest of its links.
    """
    groups = components.components(left.select(F.bitwise_not("key").alias("bucket"), "row"), "bucket", "row").toDF("node", "part")
    texts = left.groupBy("row").agg(*[F.first(c).alias(c) for c in ("size", "root")])
    texts = common.materialise(texts.join(groups, F.col("row") == F.col("node")).select("part", "row", "size", "root"), "near-groups")
    sets = common.materialise(shingle_sets(texts, rows, row_col, text_col), "near-sets-tiles")
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_SHINGLES)).cast("int")
    tiled = texts.join(texts.groupBy("part").agg(tiles.alias("tiles")), "part").withColumn("own", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(sets, "row")
    tiled = tiled.select("part", "row", "size", "root", "shingles", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def compare(group):
        row, size, root, own = (group[c].to_numpy() for c in ("row", "size", "root", "own"))
        ends, flat = group["shingles"].offsets.to_numpy(), group["shingles"].values.to_numpy()
        sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
        one = np.flatnonzero(own == group["one"][0].as_py())
        two = one if group["one"][0] == group["two"][0] else np.flatnonzero(own == group["two"][0].as_py())
        found = list(set_links(size.astype(np.int64), root, sets, one, two)) if len(one) and len(two) else []
        if found:
            x, y = row[[i for i, _ in found]], row[[k for _, k in found]]
            yield from _batch([(x, y)])

    return components.by_group(tiled, ["part", "one", "two"], compare, _PAIRS, common.partitions_of(sets))


def hubs(long: DataFrame) -> DataFrame:
    """key, hub, hub_size, hub_rest: of each bucket the text nearest to the bitwise majority of its fingerprints, as a base is among its copies."""
    ones = [F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    majority = long.groupBy("key").agg(F.count("*").alias("n"), *ones)
    bits = [F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    majority = majority.select("key", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("centre"))
    nearest = F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("away"), "row", "size", "rest")).alias("hub")
    return long.join(majority, "key").groupBy("key").agg(nearest).select("key", F.col("hub.row").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.rest").alias("hub_rest"))


def feasible(long: DataFrame) -> DataFrame:
    """The rows of long buckets that may have a partner there.

    The smaller set of a pair has at least 8/9 of its shingles from the shared one on.
    A bucket without such sets has no pairs, and a larger set needs one of a size
    that it can be similar to.
    """
    small = 9 * F.col("rest") >= 8 * F.col("size")
    sizes = long.groupBy("key").agg(F.min(F.when(small, F.col("size"))).alias("least"), F.max(F.when(small, F.col("size"))).alias("most"), F.count_if(small).alias("smalls")).where("smalls > 0")
    large = (4 * (F.col("least") + F.col("size")) <= 9 * F.col("rest")) & (5 * F.col("most") >= 4 * F.col("size"))
    return long.join(sizes, "key").where(small | large).drop("least", "most", "smalls")


def simhash_pairs(chosen: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: a forest over the pigeonring chains of the distinct fingerprints, and classes of one fingerprint paired with its first."""
    first = F.min(F.struct("row", "size")).alias("low")
    first = common.materialise(chosen.groupBy("fp").agg(first).select("fp", F.col("low.row").alias("low"), F.col("low.size").alias("low_size")), "near-fingerprints")
    alike = chosen.join(first, "fp").where("row != low").select("low", "low_size", "row", "size")
    apart = simhash.links(first.select("fp")).join(first.toDF("a", "low", "low_size"), "a").join(first.toDF("b", "row", "size"), "b").select(*alike.columns)
    return alike.unionByName(apart).where(may_link_sql("size", "size", "low_size", "low_size")).select(F.least("low", "row").alias("a"), F.greatest("low", "row").alias("b"))


def links(chosen: DataFrame, rows: DataFrame, row_col: str, text_col: str, order: Rarity) -> DataFrame:
    """Links (a, b) that keep all components of similar sets; ``chosen`` has row, size and fp of one text a class."""
    keyed = prefixes(rows, row_col, text_col, order).join(chosen, "row").select("row", "size", "fp", F.explode(F.arrays_zip("keys", "rests")).alias("k"))
    keyed = common.materialise(keyed.select(F.col("k.keys").alias("key"), "row", "size", F.col("k.rests").alias("rest"), "fp"), "near-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = common.materialise(keyed.join(sizes, "key").select("key", "row", "size", "rest", "fp", "n"), "near-buckets")
    common.discard(keyed)
    partitions = common.partitions_of(listed)
    bucket = ["key", "row", "size", "rest"]
    short = listed.where(F.col("n") <= LONG)

    long = common.materialise(feasible(listed.where(F.col("n") > LONG).drop("n")), "near-long")
    # A text needs one bucket to meet a hub; what the stars leave apart is compared in all of them.
    one = long.groupBy("row").agg(F.min("key").alias("key"))
    stars = long.join(one, ["row", "key"]).join(hubs(long), "key").where((F.col("row") != F.col("hub")) & may_link_sql("size", "size", "hub_size", "hub_size")).select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b"))

    first = simhash_pairs(chosen).unionByName(in_buckets(short.select(*bucket), partitions)).unionByName(stars).distinct()
    first = common.materialise(first, "near-pairs-first")
    found = verified(first, rows, row_col, text_col, "first")
    roots = components.components(found, "a", "b")

    def rooted(df):
        return df.join(roots, F.col("row") == F.col("node"), "left").select(*bucket, F.coalesce("root", "row").alias("root"))

    again = in_buckets(rooted(short.where(F.col("n") > SHORT)), partitions).distinct().join(first, ["a", "b"], "left_anti")
    second = common.materialise(again, "near-pairs-second")
    left = rooted(long)
    mixed = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = common.materialise(left.join(mixed, "key", "left_semi").drop("rest"), "near-left")
    crossed = common.materialise(in_tiles(left, rows, row_col, text_col), "near-links-tiles")
    common.discard(listed, long, left, first)
    out = found.unionByName(crossed).unionByName(verified(second, rows, row_col, text_col, "second"))
    common.discard(second)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component of near copies keeps its smallest id.

    Texts without words are copies of each other.  Of rows that repeat the smallest
    id one stays, whichever; a component without any id keeps one row.  Columns of
    any name come through; an empty table gives no rows.
    """
    (number,) = common.fresh(docs, "row")
    with common.small_batches(docs.sparkSession):
        rows = common.materialise(docs.withColumn(number, F.monotonically_increasing_id()), "near-input")
        size = max(1, common.written_bytes(rows))
        part_bits = min(20, max(6, (size // PART_BYTES).bit_length()))
        cell_bits = min(CELL_BITS, max(16, size.bit_length()))
        marked = common.materialise(marks(rows, number, id_col, text_col, part_bits), "near-marks")
        order = rarity(marked, part_bits, cell_bits)
        texts = marked.where(F.col("part").isNull())
        by_id = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        classes = common.materialise(texts.groupBy("class").agg(F.min(by_id).alias("first")).select("first"), "near-classes")
        chosen = common.materialise(texts.join(classes.select(F.col("first.row").alias("row")), "row", "left_semi").select("row", "size", "fp"), "near-chosen")
        common.discard(marked)
        roots = components.components(links(chosen, rows, number, text_col, order), "a", "b")
        common.discard(chosen)
    stay = (
        classes.join(roots, F.col("first.row") == F.col("node"), "left").groupBy(F.coalesce("root", "first.row").alias("root"))
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias(number))
    )
    return rows.join(stay, number, "left_semi").drop(number)
