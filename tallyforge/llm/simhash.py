"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of eight segments of eight bits.  If two
differ in at most 3 bits, some segment starts a chain in which every prefix of l
segments differs in at most l * 3 / 8 bits: 0, 0, 1, 1, 1, 2, 2, 3.  The first two
segments are thus equal, and of the next three at most one differs, so the pair
shares a key of 32 bits: the start, which of those three is left out, and the
other four segments.  24 keys a fingerprint find all such pairs; the whole chain
is then checked before the full Hamming distance.

Only distinct fingerprints are compared, and a bucket gives a spanning forest of
its links, never all pairs.  Buckets of more than ``BUCKET`` fingerprints are cut
further by the same argument on the bits they do not share (32, 24, 18, 14, 11,
9), so after five cuts a bucket has 2 ** 9 fingerprints at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

SEED = 42
DISTANCE = 3
SEGMENTS = 8
BUDGETS = tuple(n * DISTANCE // SEGMENTS for n in range(1, SEGMENTS + 1))
BUCKET = 1024
_CUTS = pa.schema([("chain", pa.int32()), ("next", pa.int32()), ("mask", pa.int64())])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words (all words if fewer; none: empty)."""
    run = text.lower().split()
    if not run:
        return np.empty(0, np.uint64)
    joined = b" ".join(run)
    if len(run) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    n = len(run) - words + 1
    ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
    begins = np.concatenate(([0], ends[: n - 1]))
    digest, ends = xxhash.xxh64_intdigest, ends[words - 1 :] - 1
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.uint64, n)


def of_hashes(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    return of_hashes(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long).  Only A-Z are lowered; words part at ASCII white space; null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))

    def mark(batches):
        for b in common.rows_of(batches):
            marks = np.array([fingerprint(x, words) for x in common.texts_as_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(mark, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chains() -> list[tuple[int, int]]:
    """(start, mask of shared bits) of the 24 keys."""
    out = []
    for start in range(SEGMENTS):
        for left_out in (2, 3, 4):
            kept = [(start + i) % SEGMENTS for i in range(5) if i != left_out]
            out.append((start, sum(255 << 8 * k for k in kept)))
    return out


def cut_further(chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each chain's four refinements (numbers 4c to 4c + 3).

    Linked pairs differ in at most 3 of the bits that a mask leaves, so of four
    parts of those at least one is equal too.
    """
    out = []
    for start, mask in chain:
        free = [p for p in range(64) if not mask >> p & 1]
        for k in range(DISTANCE + 1):
            out.append((start, mask | sum(1 << p for p in free[k :: DISTANCE + 1])))
    return out


def within_chain(a: np.ndarray, b: np.uint64, start: int) -> np.ndarray:
    """Which of ``a`` link with ``b`` by the chain from ``start``: each prefix keeps its budget, the last being the Hamming check."""
    x = a ^ b
    spent = np.zeros(x.shape, np.uint8)
    passed = np.ones(x.shape, bool)
    for n, budget in enumerate(BUDGETS):
        spent += np.bitwise_count((x >> np.uint64(8 * ((start + n) % SEGMENTS))) & np.uint64(255))
        passed &= spent <= budget
    return passed


def bucket_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that this chain start shows among a bucket's distinct fingerprints."""
    left, out = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            fp = front.pop()
            hit = within_chain(left, fp, start)
            if hit.any():
                out += [(fp, x) for x in left[hit]]
                front += list(left[hit])
                left = left[~hit]
    return out


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep all components of "at most 3 bits differ"."""
    spark = distinct.sparkSession
    chain = chains()
    keys = F.array(*[F.struct(F.lit(c).alias("chain"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("value")) for c, (_, mask) in enumerate(chain)])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.chain", "key.value")
    found, level = [], 0
    while True:
        sizes = keyed.groupBy("chain", "value").agg(F.count("*").alias("n")).where("n > 1")
        shared = common.materialise(keyed.join(sizes, ["chain", "value"]), f"simhash-buckets-{level}")
        starts = [start for start, _ in chain]

        def link(rows, starts=starts):
            fps = rows["fp"].to_numpy().view(np.uint64)
            if out := bucket_links(fps, starts[rows["chain"][0].as_py()]):
                both = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        found.append(components.by_group(shared.where(F.col("n") <= bucket).drop("n"), ["chain", "value"], link, "a long, b long", common.partitions_of(shared)))
        large = shared.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        held = sorted(r["chain"] for r in large.select("chain").distinct().collect())  # at most 24 * 4 ** level
        chain, level = cut_further([chain[c] for c in held]), level + 1
        cuts = common.small_table(spark, [(held[c // 4], c, _signed(mask)) for c, (_, mask) in enumerate(chain)], _CUTS)
        keyed = large.select("fp", "chain").join(F.broadcast(cuts), "chain").select("fp", F.col("next").alias("chain"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def group(marked: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for ``fingerprints``' rows (a written table): the smallest doc_id reachable by links.

    Equal fingerprints are one class; repeated ids and null ids are rows like others (a
    component of null ids only has a null component_id); an empty table gives no rows.
    """
    classes = common.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = components.components(links(classes.select("fp")), "a", "b")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    marked = common.materialise(fingerprints(docs, words, id_col, text_col), "simhash-fingerprints")
    return group(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each group of near-duplicates keeps its smallest id.

    Of rows that repeat this id one stays, whichever; a group without any id keeps
    one row.  Rows get a number of their own first, which breaks such ties.  Columns
    of any name come through.
    """
    (number,) = common.fresh(docs, "row")
    numbered = common.materialise(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-input")
    ordered = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.col(number).alias("row"))
    marked = common.materialise(fingerprints(numbered, words, number, text_col).toDF("n", "fp"), "simhash-fingerprints")
    keyed = numbered.select(F.col(number).alias("n"), ordered.alias("order")).join(marked, "n").select("fp", "order")
    keyed = common.materialise(keyed.groupBy("fp").agg(F.min("order").alias("first")), "simhash-classes")
    roots = components.components(links(keyed.select("fp")), "a", "b")
    stay = (
        keyed.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias(number))
    )
    return numbered.join(stay, number, "left_semi").drop(number)
