"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 3 letters with their marks,
words padded with one blank) by falling count.  A document goes to the language whose profile
its own has the smallest out-of-place distance to: the sum of rank differences,
with the profile length for n-grams the language's profile lacks.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from . import common

PROFILE = 300
UNKNOWN = "und"
BLANK, BITS = 1, 21  # three code points of 21 bits fill 63; no letter has code point 1


@functools.cache
def _letters() -> np.ndarray:
    """By code point: 1 letter, 2 combining mark (it goes on with a word, but begins none and is no letter of its own), 0 other."""
    kinds = (1 if c.isalpha() else 2 * (unicodedata.category(c)[0] == "M") for c in map(chr, range(0x110000)))
    return np.fromiter(kinds, np.uint8, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """All n-grams of the whole text, each as one integer; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _letters()[points]
    is_letter = kind == 1
    if not is_letter.any():
        return np.empty(0, np.int64)
    if (marks := np.flatnonzero(kind == 2)).size:
        # A run of marks belongs to the word if a letter stands right before it.
        before = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind)), -1))[marks]
        is_letter[marks[(before >= 0) & is_letter[before]]] = True
    padded = np.full(len(points) + 2, BLANK, np.int64)
    padded[1:-1][is_letter] = points[is_letter]
    blank = padded == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = ~blank[1]
    row = padded[keep]
    if row[0] != BLANK:
        row = np.concatenate(([BLANK], row))
    two = row[:-1] << BITS | row[1:]
    three = (two[:-1] << BITS | row[2:])[row[1:-1] != BLANK]
    return np.concatenate((row[row != BLANK], two, three))


def top_ngrams(text: str, size: int = PROFILE) -> np.ndarray:
    """The document's profile: its most frequent n-grams, ties by the n-gram's integer."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all languages in ``docs``, counted over every row with text and language.

    Counting is partial in each task and summed by (language, n-gram); only
    ``size`` n-grams a language reach the driver (at most a few thousand languages exist).
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (grams, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["l", "g", "n"])
            held.clear()

        for b in common.rows_of(batches, 96):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    grams, where = np.unique(np.concatenate((held[lang][0], grams)), return_inverse=True)
                    counts = np.bincount(where, weights=np.concatenate((held[lang][1], counts)), minlength=len(grams)).astype(np.int64)
                held[lang] = grams, counts
            if sum(len(g) for g, _ in held.values()) > 1_000_000:
                yield from flush()
        yield from flush()

    totals = rows.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("l", "r").collect():
        out.setdefault(r["l"], []).append(r["g"])
    return out


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language (first by name among equals) and a score in 0..1: one less the distance as a share of the largest."""
        top = top_ngrams(text, self.size) if text else ()
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        ranks = self.ranks[at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(top))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score (``names``) to the id column (and ``keep`` columns) by the text alone.

    Null text and text without a letter give ``und`` and 0, as does having learned
    nothing; repeated rows and null ids are kept; whole texts are read.
    """
    out = list(dict.fromkeys((id_col, *keep)))
    rows = docs.select(*out) if text_col in out else docs.select(*out, text_col)
    fields, n, at = docs.select(*out).schema.fields, len(out), rows.columns.index(text_col)

    def classify(batches):
        classifier = Classifier(profiles, size)
        for b in common.rows_of(batches):
            found = [classifier(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*b.schema.names[:n], *names])

    return rows.mapInArrow(classify, StructType([*fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows not held out and predicts all rows: doc_id, held_out, lang_pred, score."""
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), held_out(id_col).alias("held_out"))
    profiles = learn(split.where(~F.col("held_out")), "t", "l")
    return predict(split, profiles, id_col="doc_id", text_col="t", keep=("held_out",))
