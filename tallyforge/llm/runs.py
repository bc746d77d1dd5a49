"""Periodic runs of words, found on a harmonic grid with longest common extensions.

A run is a stretch of consecutive words with smallest period p (words p apart are
identical) and a length of at least two periods that no neighbouring word extends.
Every such stretch covers two neighbouring multiples of p.  So for each period p the
grid points jp and (j + 1)p are compared: how far the words agree from there on and
before, by suffix array and range minima of the word sequence and of its reverse.
The grids of all periods have n + n/2 + n/3 + ... points, so a text of n words takes
n log n such queries, whatever it repeats.

Texts are handled many at a time: their words follow one another with separators of
their own, which nothing equals, so one pair of suffix arrays serves all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of texts that are handled together; a longer text goes alone.
TOGETHER = 1 << 16
#: Grid points compared at once.
POINTS = 1 << 19
LEAST = 12


class Extensions:
    """Longest common extensions of an integer sequence: suffix array by doubling, LCPs of neighbours, range minima."""

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        _, rank = np.unique(sequence, return_inverse=True)
        names, step = [rank.astype(np.int32)], 1
        order = np.argsort(rank)
        # names[k][i] is the rank of the 2**k items from i on: equal exactly where they are.
        while step < n:
            rank = names[-1].astype(np.int64)
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            new = key[order]
            ranks = np.empty(n, np.int32)
            ranks[order] = np.cumsum(np.concatenate(([False], new[1:] != new[:-1])), dtype=np.int32)
            names.append(ranks)
            step *= 2
            if ranks[order[-1]] == n - 1:
                break
        self.rank = np.empty(n, np.int32)
        self.rank[order] = np.arange(n, dtype=np.int32)
        # Neighbours' common prefixes, from long pieces to short ones.
        a, b = order[:-1].copy(), order[1:].copy()
        common_ = np.zeros(max(0, n - 1), np.int32)
        for k in range(len(names) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[names[k][a[inside]] == names[k][b[inside]]]
            # A name may stand for a piece that the sequence's end cuts short; the last item is unlike all others, so equal names mean equal whole pieces.
            common_[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        m = len(common_)
        self.minima = np.empty((max(1, m.bit_length()), m), np.int32)  # [k, i]: the least of 2**k values from i on
        self.minima[0] = common_
        for k in range(1, len(self.minima)):
            w = 1 << (k - 1)
            self.minima[k, : m - 2 * w + 1] = np.minimum(self.minima[k - 1, : m - 2 * w + 1], self.minima[k - 1, w : m - w + 1])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (i != j)."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.minima[level, low], self.minima[level, high - (1 << level)])


class Found(NamedTuple):
    """Runs of several texts: text number, first word, length and period, by text, then start, then period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def grid(counts: np.ndarray, begins: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, first point) of all grid pairs, about ``POINTS`` at a time; ``begins`` are the texts' places in the sequence."""
    texts = np.flatnonzero(counts >= max(2, least))
    halves = counts[texts] // 2
    text = np.repeat(texts, halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    points = (counts[text] - 1) // period
    stops = np.searchsorted(np.cumsum(points), np.arange(POINTS, int(points.sum()) + POINTS, POINTS), side="right")
    for k, part in enumerate(stops.tolist()):
        cut = slice(stops[k - 1] if k else 0, max(part, 1 + (stops[k - 1] if k else 0)))
        n = points[cut]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of, p = np.repeat(text[cut], n), np.repeat(period[cut], n)
        yield of, p, begins[of] + j * p


def find(texts: list[np.ndarray], least: int = LEAST) -> Found:
    """All runs of at least ``least`` words in sequences of numbers (at least 0)."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(counts + 1) - counts  # a separator stands before each text, and one after the last
    n = int(counts.sum()) + len(texts) + 1
    sequence = np.empty(n, np.int64)
    is_word = np.ones(n, bool)
    is_word[begins - 1] = is_word[-1] = False
    if len(texts):
        sequence[is_word] = np.concatenate(texts)
    sequence[~is_word] = -1 - np.arange(len(texts) + 1)
    parts = []
    if counts.max(initial=0) >= least:
        ahead, back = Extensions(sequence), Extensions(sequence[::-1].copy())
        for of, p, at in grid(counts, begins, least):
            alike = sequence[at] == sequence[at + p]  # both points lie in the stretch, so their words agree
            of, p, at = of[alike], p[alike], at[alike]
            forward = ahead(at, at + p)
            # The reverse of the sequence goes on, after position i - 1, with what stands before i.
            backward = back(n - at, n - at - p)
            length = backward + forward + p
            hit = np.flatnonzero((length >= 2 * p) & (length >= least))
            parts.append((of[hit], (at - backward)[hit] - begins[of[hit]], length[hit], p[hit]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Found(none, none, none, none)
    text, start, length, period = (np.concatenate(x) for x in zip(*parts, strict=True))
    # Several points find one stretch, and so do multiples of its smallest period: the first of each stretch is the run.
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[first], start[first], length[first], period[first]
    order = np.lexsort((period, start, text))
    return Found(text[order], start[order], length[order], period[order])


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] == 0


def together(batches, limit: int = TOGETHER) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words) of texts that hold about ``limit`` words in sum."""
    ids, words, size = [], [], 0
    for b in common.rows_of(batches):
        for k, text in zip(b.column(0).to_pylist(), common.texts_as_bytes(b.column(1)), strict=True):
            own = text.split()
            if ids and size + len(own) > limit:
                yield ids, words
                ids, words, size = [], [], 0
            ids.append(k)
            words.append(own)
            size += len(own)
    if ids:
        yield ids, words


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, its runs (by start, then period) and ``collapsed``.

    Words are what stands between ASCII white space.  A run has at least ``least``
    words and two periods, and its period is its smallest.  ``collapsed`` joins by
    one space the words that stay when every run keeps its first period.  Null text
    has no words and runs; rows with equal or null ids and equal rows are kept;
    extra columns are not read; an empty table gives no rows.  A text is handled
    whole in its task: memory grows with its number of words and their logarithm.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in together(batches):
            counts = [len(w) for w in words]
            flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            found = find(np.split(flat, ends[:-1]), least)
            n_runs = np.bincount(found.text, minlength=len(ids))
            begin = np.concatenate(([0], np.cumsum(n_runs)))
            collapsed = []
            for k, own in enumerate(words):
                if n_runs[k]:
                    part = slice(begin[k], begin[k + 1])
                    stay = kept_words(len(own), found.start[part], found.length[part], found.period[part])
                    own = [own[i] for i in np.flatnonzero(stay).tolist()]
                collapsed.append(b" ".join(own))
            spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found[1:]], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), spans), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("t")).mapInArrow(work, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` gives as one row of numbers and digests: the longest run (ties: smallest start, then period), all runs and the collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    some = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), lines.alias("lines"), "collapsed")
    length = -F.col("best.shorter")
    return some.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode("lines", "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
