"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

Every labeller votes bad, good or abstains.  Expectation-maximisation over the
counts of vote patterns (at most 3 ** labellers rows, counted over all documents)
estimates how each labeller votes on good and on bad documents; the posterior of
a document's pattern is its weak label.  A linear scorer over hashed byte n-grams
learns the posteriors of a bounded sample and then scores every whole text.
"""

from __future__ import annotations

import re
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import common

BAD, NONE, GOOD = 0, 1, 2
#: Expected size of the sample that the scorer is fitted on; the label model uses all documents.
SAMPLE = 2000
BINS = 1 << 12
#: 3-grams that the scorer has learned from are told by hashes of so many bits.
KNOWN = 20
STEPS = 400
#: Documents below this score are dropped; short clean texts say little, so the bar is below one half.
KEEP_FROM = 0.2


def _kinds() -> np.ndarray:
    """Per byte: 1 lower-case letter or first byte of a non-ASCII character, 2 upper case, 3 digit, 4 sentence mark, 5 other symbol, 0 white space, control and further bytes of a character, so that counts are of characters."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 5
    kind[0xC0:] = 1
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[*b".,;:'\"-?()"]] = 4
    return kind


_OF_KIND = (_kinds()[:, None] == np.arange(6)).astype(np.int64)
# Beginnings of characters of scripts that set no blanks between words: Thai, Lao, Tibetan, Burmese and Khmer here; kana, Han and Hangul begin with E3 to ED.
_UNSPACED = re.compile(rb"\xe0[\xb8-\xbf]|\xe1[\x80-\x82\x9e\x9f]")
#: Characters of those scripts that count as a word.
UNSPACED_WORD = 4


def _bad_from(value: float, least: float) -> int:
    return BAD if value >= least else NONE


class Page(NamedTuple):
    """What labellers look at: characters by kind, words, lines, the shares of words that repeat the one before, and the two before, and characters a word."""

    kinds: np.ndarray
    words: list[bytes]
    lines: list[bytes]
    same_words: float
    in_runs: float
    length: float

    @classmethod
    def of(cls, text: bytes) -> Page:
        words = text.split()
        n = max(1, len(words) - 1)
        same = list(map(bytes.__eq__, words, words[1:]))
        same_words, in_runs = sum(same) / n, sum(map(and_, same, same[1:])) / n
        n_bytes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        kinds = n_bytes @ _OF_KIND
        unspaced = int(n_bytes[0xE3:0xEE].sum()) + (len(_UNSPACED.findall(text)) if n_bytes[0xE0] or n_bytes[0xE1] else 0)
        return cls(kinds, words, text.split(b"\n"), same_words, in_runs, kinds[1:].sum() / max(1, len(words) + unspaced / UNSPACED_WORD))


#: All but the last look for one fault each and abstain otherwise, as the lack of one fault says little about others.
LABELLERS = {
    "symbols": lambda p: _bad_from(p.kinds[5] / max(1, p.kinds[1:].sum()), 0.05),
    "few_letters": lambda p: _bad_from(1 - (p.kinds[1] + p.kinds[2]) / max(1, p.kinds[1:].sum()), 0.25),
    "upper_case": lambda p: _bad_from(p.kinds[2] / max(1, p.kinds[1] + p.kinds[2]), 0.40),
    "marked_words": lambda p: _bad_from(sum(w[-1] in b"!*#$%&|" for w in p.words) / max(1, len(p.words)), 0.15),
    "repeated_words": lambda p: _bad_from(p.same_words, 0.10) if len(p.words) >= 15 else NONE,
    "word_runs": lambda p: _bad_from(p.in_runs, 0.06) if len(p.words) >= 15 else NONE,
    "repeated_lines": lambda p: _bad_from(1 - len(set(p.lines)) / len(p.lines), 0.50) if len(p.lines) >= 5 else NONE,
    "prose": lambda p: GOOD if p.kinds[1:].sum() >= 3 * p.length and 2.5 <= p.length <= 9 and p.kinds[5] == 0 and p.kinds[2] <= 0.2 * p.kinds[1] and p.same_words < 0.05 else NONE,
}


def votes(page: Page) -> list[int]:
    return [f(page) for f in LABELLERS.values()]


def pattern(text: bytes, page: Page | None = None) -> int:
    out = 0
    for v in votes(page or Page.of(text)):
        out = out * 3 + v
    return out


class LabelModel(NamedTuple):
    """``odds[l, c, v]``: the chance that labeller l votes v on class c (0 bad, 1 good)."""

    prior: float
    odds: np.ndarray
    rounds: int

    def posterior(self, codes) -> np.ndarray:
        digits = _digits(np.asarray(codes, dtype=np.int64))
        log = np.log([[1 - self.prior], [self.prior]]) + sum(np.log(self.odds[k][:, digits[:, k]]) for k in range(len(LABELLERS)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def accuracies(self) -> dict[str, float]:
        """Per labeller: the chance that a vote it casts is right."""
        weight = np.array([1 - self.prior, self.prior])
        right = self.odds[:, 0, BAD] * weight[0] + self.odds[:, 1, GOOD] * weight[1]
        cast = ((1 - self.odds[:, :, NONE]) * weight).sum(1)
        return dict(zip(LABELLERS, (right / cast).tolist(), strict=True))


def _digits(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], 1)


def fit_labels(counts: dict[int, int], rounds: int = 200, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation from a start where each vote is ten times as likely on its own class; one pseudo-count a cell."""
    m = len(LABELLERS)
    odds = np.tile(np.array([[0.40, 0.56, 0.04], [0.04, 0.56, 0.40]]), (m, 1, 1))
    model = LabelModel(0.8, odds, 0)
    if not counts:
        return model
    codes, n = np.array(list(counts), dtype=np.int64), np.array(list(counts.values()), dtype=np.float64)
    digits = _digits(codes)
    for k in range(rounds):
        good = model.posterior(codes)
        weight = np.stack([(1 - good) * n, good * n])
        odds = np.stack([[np.bincount(digits[:, j], weights=w, minlength=3) + 1 for w in weight] for j in range(m)])
        odds /= odds.sum(2, keepdims=True)
        after = LabelModel(float((weight[1].sum() + 1) / (n.sum() + 2)), odds, k + 1)
        moved = np.abs(after.odds - model.odds).max()
        model = after
        if moved < tolerance:
            break
    return model


def _bin(name: bytes) -> int:
    return xxhash.xxh64_intdigest(name) % BINS


_SAME_WORD, _SAME_LINE = map(_bin, (b"same word", b"same line"))


def trigrams(text: bytes) -> np.ndarray:
    """All byte 3-grams (case kept, ends padded) as integers."""
    b = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]


def mixed(grams: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hashes of so many bits."""
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - bits)


def hashed(text: bytes, page: Page | None = None, grams: np.ndarray | None = None) -> np.ndarray:
    """Square-rooted shares over ``BINS`` hashed features: byte 3-grams, and words and lines that repeat."""
    grams = trigrams(text) if grams is None else grams
    if not len(grams):
        return np.zeros(BINS, np.float32)
    share = np.bincount(mixed(grams, 12), minlength=BINS) / len(grams)
    page = page or Page.of(text)
    share[_SAME_WORD] += page.same_words
    share[_SAME_LINE] += 1 - len(set(page.lines)) / len(page.lines)
    return np.sqrt(share).astype(np.float32)


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float

    def __call__(self, features: np.ndarray) -> float:
        z = float(features @ self.weights) + self.bias
        return float(1 / (1 + np.exp(np.clip(-z, -700, 700))))


def fit_scorer(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, steps: int = STEPS, l2: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by gradient steps with momentum; ``n`` counts each row, and both classes weigh alike.

    Where all labels say nearly the same there is nothing to tell apart: the score is
    their mean for every text.
    """
    if not len(x):
        return Scorer(np.zeros(BINS, np.float32), 0.0)
    n = np.ones(len(y)) if n is None else n * (len(y) / n.sum())
    mass = np.array([((1 - y) * n).sum(), (y * n).sum()])
    if y.max() - y.min() < 1e-3:
        share = np.clip(mass[1] / mass.sum(), 1e-6, 1 - 1e-6)
        return Scorer(np.zeros(BINS, np.float32), float(np.log(share / (1 - share))))
    weight = n * (y * mass.sum() / (2 * max(mass[1], 1e-9)) + (1 - y) * mass.sum() / (2 * max(mass[0], 1e-9)) if mass.min() > 1e-3 else np.ones(len(y)))
    mean = x.mean(0)
    centred = np.ascontiguousarray(x - mean, dtype=np.float32)
    features = x.shape[1]
    del x  # where the caller holds no other name of it, two copies live at once and not three
    across = np.ascontiguousarray(centred.T)
    w, dw, bias, db = np.zeros(features, np.float32), np.zeros(features, np.float32), 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(centred @ w + bias, -50, 50)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        dw = np.float32(0.9) * dw - np.float32(8.0) * (across @ g + np.float32(l2) * w)
        db = 0.9 * db - 1.0 * float(g.sum())
        w, bias = w + dw, bias + db
    return Scorer(w, float(bias - mean @ w))


class QualityModel(NamedTuple):
    """``known``: a bit for each of 2 ** ``KNOWN`` hashes of the 3-grams that the scorer has learned from."""

    labels: LabelModel
    scorer: Scorer
    known: bytes


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("t"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Counts patterns over all documents; the scorer learns from about ``sample`` distinct rows taken by a hash of id and text.

    A row that repeats is one row of the sample with its count as weight.  The same
    rows are taken in whatever order and partitions they come; at most twice
    ``sample`` are, those with the smallest hashes.
    """

    def count(batches):
        for b in common.rows_of(batches):
            codes, n = np.unique(np.array([pattern(x) for x in common.texts_as_bytes(b.column(0))], dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    counted = _texts(docs, text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 3 ** labellers rows
    labels = fit_labels({r["code"]: r["n"] for r in counted})
    hashed_row = F.xxhash64(F.col(id_col), F.col(text_col))
    distinct = docs.agg(F.approx_count_distinct(hashed_row)).first()[0]
    chance = min(1.0, sample / max(1, distinct))
    chosen = docs.select(hashed_row.alias("h"), F.col(text_col).cast("string").alias("t")).where(F.pmod("h", F.lit(1 << 30)) <= int(chance * (1 << 30)))
    chosen = common.materialise(chosen.groupBy("h").agg(F.min("t").alias("t"), F.count("*").alias("n")), "quality-sample")
    first = chosen.select("h").orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(2 * sample)  # hashes only, so that no task gets all the texts
    taken = chosen.join(F.broadcast(first), "h", "left_semi")

    def describe(batches):
        for b in common.rows_of(batches):
            texts = common.texts_as_bytes(b.column(0))
            features = [hashed(x) for x in texts]
            held = [np.flatnonzero(x) for x in features]
            at, x = (pa.array([v.tobytes() for v in some], pa.binary()) for some in ([k.astype("<u2") for k in held], [v[k] for v, k in zip(features, held, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in texts], pa.int64()), at, x, b.column(1), b.column(2)], names=["code", "at", "x", "n", "h"])

    def seen(batches):
        held = np.zeros(1 << KNOWN, bool)
        for b in common.rows_of(batches):
            for x in common.texts_as_bytes(b.column(0)):
                held[mixed(trigrams(x), KNOWN)] = True
        words = np.packbits(held, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    rows = sorted(taken.select("t", "n", "h").mapInArrow(describe, "code long, at binary, x binary, n long, h long").collect(), key=lambda r: r["h"])  # at most 2 * sample rows, 6 bytes a feature that a text has
    words = np.zeros(1 << (KNOWN - 6), "<i8")
    for r in taken.select("t").mapInArrow(seen, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():  # at most 2 ** (KNOWN - 6) rows
        words[r["at"]] = r["word"]
    known = np.unpackbits(words.view(np.uint8), bitorder="little")
    common.discard(chosen)

    def dense() -> np.ndarray:
        x = np.zeros((len(rows), BINS), np.float32)
        for k, r in enumerate(rows):
            x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], np.float32)
        return x

    return QualityModel(labels, fit_scorer(dense(), labels.posterior([r["code"] for r in rows]) if rows else np.empty(0), np.array([r["n"] for r in rows], dtype=np.float64)), np.packbits(known).tobytes())


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = KEEP_FROM, names: tuple[str, str, str] = ("posterior", "score", "keep")) -> DataFrame:
    """id, ``keep`` columns, posterior (weak label), score and keep = score >= threshold (``names``), for every row.

    The score is the linear scorer's for the share of 3-grams that it has learned
    from, and the weak label's for the rest: of a script that no sampled row has, the
    scorer knows nothing.  Null text is empty; its vote pattern and n-grams are those of no words.  Repeated
    rows and null ids are kept; an empty table gives no rows.
    """
    out = list(dict.fromkeys((id_col, *keep)))
    rows = docs.select(*out) if text_col in out else docs.select(*out, text_col)
    fields, n, at = docs.select(*out).schema.fields, len(out), rows.columns.index(text_col)

    def score(batches):
        known = np.unpackbits(np.frombuffer(model.known, np.uint8)).view(bool)
        for b in common.rows_of(batches):
            texts = common.texts_as_bytes(b.column(at))
            pages = [Page.of(x) for x in texts]
            posterior = model.labels.posterior([pattern(x, p) for x, p in zip(texts, pages, strict=True)])
            scores = np.empty(len(texts))
            for k, (text, page) in enumerate(zip(texts, pages, strict=True)):
                grams = trigrams(text)
                share = np.count_nonzero(known[mixed(grams, KNOWN)]) / len(grams) if len(grams) else 1.0
                scores[k] = share * model.scorer(hashed(text, page, grams)) + (1 - share) * posterior[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(posterior), pa.array(scores), pa.array(scores >= threshold)], names=[*b.schema.names[:n], *names])

    return rows.mapInArrow(score, StructType([*fields, StructField(names[0], DoubleType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())]))
