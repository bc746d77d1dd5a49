"""The pipeline's near-duplicate stage gets its close pairs by SimHash and pigeonring chains, and the quality stage stays small on the driver."""

import random
import tracemalloc

import corpus_pipeline
from tallyforge.llm import near_copies, quality, simhash


def test_close_copies_come_by_simhash(spark, monkeypatch):
    """Without the exact join of the rest, the copies within 3 bits still go, and nothing else does."""
    plain = near_copies.prefixes
    monkeypatch.setattr(near_copies, "prefixes", lambda *a: plain(*a).where("false"))
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [rng.choices(words, k=400) for _ in range(20)]
    for base in texts[:12]:
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(400)] = rng.choice(words)
            texts.append(copy)
    short = [["one", "two"], ["three"]]  # far apart, each its own
    texts = [" ".join(t) for t in texts + short]
    fps = [simhash.fingerprint(t.encode(), near_copies.WORDS) for t in texts]
    sets = [set(near_copies.shingle_set(t.encode()).tolist()) for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    want = sorted(set(low))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == want
    assert len(want) < len(texts) - 5


def test_the_scorer_is_fitted_in_little_memory(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(30))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    quality.fit(df.limit(20))
    tracemalloc.start()
    quality.fit(df)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * len(rows) * quality.BINS * 4
