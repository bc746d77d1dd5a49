"""Importance resampling towards a target distribution, with hashed word n-grams.

Documents are drawn by the logarithm of how much likelier the target makes their
features than the corpus does, plus Gumbel noise of their own.  Identical texts are
collapsed first by grouping the full text: features are made once a text, their
counts are multiplied by its copies, and its weight is joined back to all its
documents before the noise is added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import numbered
from . import common

BUCKETS = 10_000
#: Word runs of 1 to ``WIDEST`` words are features.
WIDEST = 2
#: Documents of at least this many words take part in the draw.
LEAST_WORDS = 20
PERCENT = 25

# A-Z become a-z; all other ASCII characters but digits and letters end a word.
_WORD_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8."""
    return text.translate(_WORD_BYTES).split()


class Shifts:
    """Moves CRC-32 values over following bytes: ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``.

    The move is linear in the bits of the value, so a length needs one table of 256
    entries for each of its four bytes.  Lengths up to ``longest`` have tables.
    """

    def __init__(self, longest: int = 48):
        step = np.array([zlib.crc32(bytes([x])) ^ zlib.crc32(b"\0") for x in range(256)], np.uint32)
        byte = np.arange(256, dtype=np.uint32)
        tables = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
        for _ in range(longest):
            last = tables[-1]
            tables.append(step[last & np.uint32(255)] ^ (last >> np.uint32(8)))
        self.longest, self.tables = longest, np.stack(tables).reshape(longest + 1, 1024)

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        flat, row = self.tables.ravel(), lengths.astype(np.int64) * 1024
        out = flat[row + (crc & np.uint32(255))]
        for k in (1, 2, 3):
            out ^= flat[row + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
        return out


_SHIFTS: list[Shifts] = []


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS, widest: int = WIDEST) -> list[np.ndarray]:
    """The bucket of every feature of each text: the runs of one word in order, then those of two, and so on."""
    if not _SHIFTS:
        _SHIFTS.append(Shifts())
    shifts = _SHIFTS[0]
    words = [words_of(x) for x in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, np.uint32) for _ in texts]
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    known, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    crc_of = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
    length_of = np.fromiter(map(len, known), np.int64, len(known))
    crc, length = crc_of[number], length_of[number]
    begin = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(flat)) - begin[of]

    parts, owners = [crc], [of]
    run = crc
    space = np.uint32(zlib.crc32(b" "))
    for n in range(2, widest + 1):
        # A run of n words that starts at i is the run of n - 1 from there, a space, and the word at i + n - 1.
        at = np.flatnonzero(counts[of] - place >= n)
        last = at + n - 1
        before = shifts(run[at], np.ones(len(at), np.int64)) ^ space
        grown = np.zeros(len(flat), np.uint32)
        grown[at] = shifts(before, np.minimum(length[last], shifts.longest)) ^ crc[last]
        for k in np.flatnonzero(length[last] > shifts.longest).tolist():
            grown[at[k]] = zlib.crc32(flat[last[k]], int(before[k]))
        run = grown
        parts.append(run[at])
        owners.append(of[at])
    bucket, owner = np.concatenate(parts) % np.uint32(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.split(bucket[order], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def bucket_type(buckets: int) -> str:
    """How buckets are stored."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


_TEXTS = "digest binary, copies long, buckets binary"


def distinct_features(docs: DataFrame, text_col: str, buckets: int, widest: int, name: str) -> DataFrame:
    """One written row a distinct text: its digest, how many rows hold it, and its features' buckets (null text: that of no words)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches):
            found = feature_buckets(common.texts_as_bytes(b.column(2)), buckets, widest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(bucket_type(buckets)).tobytes() for x in found], pa.binary())], names=["digest", "copies", "buckets"])

    grouped = docs.select(common.text_of(text_col).alias("t")).groupBy("t").agg(F.count("*").alias("copies"))
    return common.materialise(grouped.select(digest_of(F.col("t")).alias("digest"), "copies", "t").mapInArrow(features, _TEXTS), name)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def _flat(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows one after the other, and how many each row has."""
    held, kind = column.to_pylist(), np.dtype(bucket_type(buckets))
    return np.frombuffer(b"".join(held), kind), np.fromiter(map(len, held), np.int64, len(held)) // kind.itemsize


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features over all rows, each text times its copies.  A task sums what it reads and gives a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in common.rows_of(batches):
            flat, sizes = _flat(b.column(1), buckets)
            np.add.at(total, flat, np.repeat(b.column(0).to_numpy(), sizes))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select("copies", "buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """The gain of each bucket (a fixed number of them), in thousandths, and how features fall into buckets."""

    gains: np.ndarray
    widest: int


def fit(spark: SparkSession, source: DataFrame, target: DataFrame, buckets: int = BUCKETS, widest: int = WIDEST) -> Model:
    """Gains from written tables of distinct texts of the corpus and of the target, over all their rows.

    The driver gets one row a bucket.  A bucket's gain is the logarithm of its share
    of the target over its share of the corpus, each count plus one.
    """
    s, t = (bucket_counts(x, buckets).withColumnRenamed("n", name) for x, name in ((source, "s"), (target, "t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    total = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double"))
    rows = every.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # total: one row
    gains = np.zeros(buckets, np.int64)
    for r in rows:
        gains[r.bucket] = r.gain
    return Model(gains, widest)


def weigh(texts: DataFrame, model: Model) -> DataFrame:
    """digest, n_features and weight (the floored mean gain of its features; none: 0) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches):
            flat, sizes = _flat(b.column(1), len(model.gains))
            ends = np.concatenate(([0], np.cumsum(model.gains[flat])))
            stop = np.cumsum(sizes)
            total = ends[stop] - ends[stop - sizes]
            weight = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(weight)], names=["digest", "n_features", "weight"])

    return texts.select("digest", "buckets").mapInArrow(run, "digest binary, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, by seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", seed: int = 7,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, widest: int = WIDEST,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1 in drawn order; null: not drawn) for every row of ``docs``.

    Of the N rows with at least ``least_words`` words ``percent`` of a hundred are
    drawn, rounded down: highest scores first, ties to the smaller id.  Null text has
    no words; a null id has the noise of an empty one and comes before others at a
    tie; rows with equal ids or texts are rows of their own (equal ids at a tie in
    any order); extra columns are not read.  An empty table gives no rows; an empty
    target leaves gains that favour features which are rare in the corpus.
    """
    spark = docs.sparkSession
    texts = distinct_features(docs, text_col, buckets, widest, "resample-texts")
    aims = distinct_features(target, target_text, buckets, widest, "resample-target")
    model = fit(spark, texts, aims, buckets, widest)
    weights = common.materialise(weigh(texts, model), "resample-weights")
    common.discard(texts, aims)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(common.text_of(text_col)).alias("digest"))
    # A table of its own: AQE can then split a text that very many documents hold.
    scored = rows.join(weights, "digest").select("doc_id", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score"))
    # n words have n + (n - 1) + ... features, so enough words are enough features.
    enough = sum(max(0, least_words - k) for k in range(widest))
    scored = common.materialise(scored.withColumn("late", F.col("n_features") < enough), "resample-scored")
    common.discard(weights)
    drawn = percent * scored.where("not late").count() // 100
    ordered = numbered(scored.withColumn("lower", -F.col("score")), ["late", "lower", "doc_id"], "place", "resample-ranks")
    common.discard(scored)
    return ordered.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
