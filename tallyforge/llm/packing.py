"""Best-fit packing by length histogram.

Documents are encoded and cut into pieces of at most ``capacity`` tokens.  Only
the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus)
goes to the driver, where best-fit decreasing runs over counts.  The plan's
segments go back as a table, and pieces take slots by rank within their length.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SEGMENTS = pa.schema([(c, pa.int64()) for c in ("_length", "_rank", "_n", "_each", "_sequence", "_at")])
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Segment(NamedTuple):
    """``n`` pieces of ``length``, from ``rank`` on, ``each`` to a sequence, beginning with ``sequence`` at ``offset``."""

    length: int
    rank: int
    n: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Best-fit decreasing over counts: the segments and the number of sequences.

    Open sequences with equal room and contiguous numbers form one run (first, count).
    Each length takes runs from the least room that fits; a taken sequence gets as
    many equal pieces as fit.  A length splits at most one run in two places, so
    there are at most 3 * capacity segments and runs.
    """
    segments: list[Segment] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        room = length
        while left:
            room = min((r for r in runs if r >= room), default=-1)
            if room < 0:
                room = capacity
                need = -(-left // (capacity // length))
                runs.setdefault(capacity, []).append((used, need))
                used += need
            each = room // length
            waiting = runs.pop(room)
            while waiting and left:
                first, n = waiting.pop()
                full = min(n, left // each)
                taken = 0
                if full:
                    segments.append(Segment(length, rank, full * each, each, first, capacity - room))
                    if (rest := room - each * length) > 0:
                        runs.setdefault(rest, []).append((first, full))
                    taken, rank, left = full, rank + full * each, left - full * each
                if left and taken < n:
                    segments.append(Segment(length, rank, left, left, first + taken, capacity - room))
                    if (rest := room - left * length) > 0:
                        runs.setdefault(rest, []).append((first + taken, 1))
                    taken, rank, left = taken + 1, rank + left, 0
                if taken < n:
                    waiting.append((first + taken, n - taken))
            if waiting:
                runs.setdefault(room, []).extend(waiting)
            else:
                room += 1
    return segments, used


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: document, number, ids before it, length and CRC-32 of its ids (``PIECES``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))

    def encode(batches):
        ids_of = common.word_ids(tokenizer_path)
        end, step = struct.pack("<I", end_id), 4 * capacity
        for b in common.rows_of(batches, 512):
            out = []
            for key, ids in zip(b.column(0).to_pylist(), ids_of(b.column(1)), strict=True):
                data = ids.tobytes() + end
                for i, at in enumerate(range(0, len(data), step)):
                    cut = data[at : at + step]
                    out.append((key, i, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)
        ids_of.forget()

    return rows.mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``.  ``pieces`` must be a written table with ``length`` and the columns of ``order``.

    Every piece gets one slot; pieces with equal (doc_id, piece) get slots of their own; an empty
    table gives no rows; null doc_id is a value like others.  Pieces that are alike in all of
    ``order`` are ranked in one task, so it should tell apart rows that repeat very often.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    segments, _ = plan(histogram, capacity)
    table = common.small_table(pieces.sparkSession, segments, _SEGMENTS)
    ranked = common.rank_within(pieces, "length", list(order), "_slot")
    index = F.col("_slot") - F.col("_rank")
    fits = (F.col("length") == F.col("_length")) & (F.col("_slot") >= F.col("_rank")) & (F.col("_slot") < F.col("_rank") + F.col("_n"))
    return ranked.join(F.broadcast(table), fits).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(index / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(index, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole path: null text is empty (its only token is the end id), long documents are cut, equal rows are packed each, extra columns are not read."""
    pieces = encode_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    with common.small_batches(docs.sparkSession):
        pieces = common.materialise(pieces, "pieces")
    return pack(pieces, capacity, ("doc_id", "piece", "row")).drop("row")
