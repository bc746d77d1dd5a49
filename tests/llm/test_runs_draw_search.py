"""Periodic runs, importance resampling and vantage-point trees against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries, resampling, runs, vantage


def runs_of(words, least=12):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((i, n, p) for (i, n), p in found.items())


def collapsed(words, found):
    gone = {k for i, n, p in found for k in range(i + p, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def words_between_spaces(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("points", [7, 1 << 19])
def test_runs_equal_brute_force(points, monkeypatch):
    monkeypatch.setattr(runs, "POINTS", points)
    rng = random.Random(3)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(0, 7)):
            n, k = rng.choice([0, 1, 11, 12, 13, 30, 61, 100]), rng.choice([1, 2, 3, 9])
            x = [rng.randrange(k) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(2, 8)
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            texts.append(x)
        found = runs.find([np.array(x, np.int64) for x in texts])
        got = [[] for _ in texts]
        for t, *run in zip(*(x.tolist() for x in found), strict=True):
            got[t].append(tuple(run))
        assert got == [runs_of(x) for x in texts]


def test_long_fibonacci_words_and_one_letter():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    found = runs.find([np.array(b, np.int64), np.zeros(5000, np.int64)])
    assert sorted(zip(*(x[found.text == 0].tolist() for x in found[1:]), strict=True)) == runs_of(b)
    assert [x[found.text == 1].tolist() for x in found[1:]] == [[0], [5000], [1]]


def test_periodic_runs_of_odd_documents(spark, odd_docs, no_docs):
    got = runs.periodic_runs(odd_docs).collect()
    assert len(got) == odd_docs.count() and runs.periodic_runs(no_docs).count() == 0
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        wants = [words_between_spaces(t) for t in texts[r.doc_id]]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) in [(len(w), runs_of(w), collapsed(w, runs_of(w))) for w in wants]
    assert any(r.runs == [(0, 3000, 1)] and r.collapsed == "word" for r in got)


def test_op11_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op11_periodic_runs(spark, sf_dir).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        words = words_between_spaces(docs[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue  # too slow for brute force; planted runs of long texts are in the tests above
        found = runs_of(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{i},{m},{q}\n" for i, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        planted += bool(found)
    assert planted > 5


def features(text, widest=2):
    lowered = (text or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256)))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return [b" ".join(words[i : i + n]) for n in range(1, widest + 1) for i in range(len(words) - n + 1)], len(words)


@pytest.mark.parametrize("widest", [1, 2, 3])
def test_buckets_equal_crc32_of_each_feature(widest):
    rng = random.Random(5)
    texts = ["", "one", "Ünïcode wörd " + "x" * 47 + " " + "y" * 48 + " " + "z" * 49 + " " + "é" * 90 + " end", "A-b_C 9z"]
    texts += [" ".join(rng.choice(["a", "Ab", "日本", "w" * rng.randrange(1, 120)]) for _ in range(rng.randrange(40))) for _ in range(60)]
    got = resampling.feature_buckets([t.encode() for t in texts], 10_000, widest)
    assert [sorted(x.tolist()) for x in got] == [sorted(zlib.crc32(f) % 10_000 for f in features(t, widest)[0]) for t in texts]
    assert resampling.feature_buckets([b"", b" "])[1].tolist() == []


def drawn(docs, target, least_words=20, percent=25):
    """(doc_id, n_features, weight, score, rank) by the definition, row by row."""
    count = lambda texts: Counter(zlib.crc32(f) % 10_000 for t in texts for f in features(t)[0])
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found, words = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in (zlib.crc32(f) % 10_000 for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least_words])
    rows.sort(key=lambda r: (not r[4], -r[3], r[0] is not None, r[0]))
    limit = percent * sum(r[4] for r in rows) // 100
    return [(*r[:4], k + 1 if k < limit else None) for k, r in enumerate(rows)]


def test_resample_equals_the_definition(spark, odd_docs, no_docs, some_docs):
    target = spark.createDataFrame([("The cat sat on the mat.", 1), (None, 2), ("the cat sat on the mat.", 3)], "text string, rank int")
    many = odd_docs.select("doc_id", "text").unionByName(some_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(spark.range(2000, 2300).select(F.col("id").alias("doc_id"), F.lit("a text that very many documents hold " * 4).alias("text")))
    rows = [(r.doc_id, r.text) for r in many.collect()]
    got = [tuple(r) for r in resampling.resample(many.withColumn("rank", F.lit(1)).withColumn("place", F.lit("clash")), target).collect()]
    want = drawn(rows, [r.text for r in target.collect()])
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[4] is not None for r in got) > 50
    assert resampling.resample(no_docs, target).count() == 0
    assert resampling.resample(many, target.where("false")).where("rank is not null").count() == sum(r[4] is not None for r in got)


def by_hand(x, ids, asked, k):
    out = {}
    for i in asked:
        s = vantage.products(x[i], x)
        order = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def searched(df, k=20, factor=vantage.FACTOR):
    out = {}
    for r in vantage.nearest(df, F.col("vec_id") % 20 == 0, k, factor).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["lengths", "ties", "copies", "few"])
def test_factor_one_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(vantage, "SHARD", 300)
    monkeypatch.setattr(vantage, "BLOCK", 16)
    rng = np.random.default_rng(4)
    if kind == "lengths":  # norms differ, so nearness is no angle
        x = rng.normal(size=(1500, 6)) * rng.lognormal(size=(1500, 1))
    elif kind == "ties":  # small whole numbers: very many equal products
        x = rng.integers(-2, 3, size=(1500, 4)).astype(float)
        x[~x.any(1), 0] = 1
    elif kind == "copies":  # a third of the rows are one vector
        x = rng.normal(size=(1200, 8))
        x[::3] = x[0]
    else:
        x = rng.normal(size=(9, 3))
    ids = np.arange(len(x))
    assert searched(frame(spark, x), factor=1.0) == by_hand(x, ids, range(0, len(x), 20), 20)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "cone"])
def test_recall_of_the_default_factor(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 48))
    if kind == "clusters":
        x = x[rng.integers(60, size=6000)] + 0.3 * rng.normal(size=(6000, 48))
    elif kind == "cone":
        x = x + 3
    x /= np.sqrt((x * x).sum(1))[:, None]
    got, want = searched(frame(spark, x)), by_hand(x, np.arange(len(x)), range(0, len(x), 20), 20)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want) and all(len(got[q]) == 20 for q in want)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0], "x"), (20, None, "x"), (40, [0.0, 0.0], "x"), (60, [1.0, None], "x"), (80, [float("nan"), 1.0], "x"), (100, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (120, [1.0, 2.0, 3.0], "x"), (1, [0.5, 0.5], "x"), (2, [1.0, 0.0], "x"), (0, [0.9, 0.0], "x"), (3, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit("clash"))
    got = sorted(map(tuple, vantage.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()))
    # Two rows have id 0: each asks, and neither gets the other; the vector of three components has no candidates.
    assert got == [(0, 1, 2, 0.9), (0, 1, 2, 1.0), (0, 2, 1, 0.45), (0, 2, 1, 0.5)]
    assert vantage.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert vantage.nearest(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        vantage.nearest(df, F.lit(True), factor=0.5)
