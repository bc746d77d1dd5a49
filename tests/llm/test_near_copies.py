"""The pipeline's near-duplicate stage against brute-force Jaccard over all pairs."""

import random
import re

import pytest

import corpus_pipeline
from tallyforge.llm import common, near_copies, simhash


def plain_set(text):
    run = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(run[i : i + 5]) for i in range(max(1, len(run) - 4))) if run else frozenset()


def plain_kept(rows):
    """Ids that stay, from all pairs (only those that share a shingle can be similar)."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, pairs = {}, set()
    for i, s in enumerate(sets):
        for x in s or {None}:
            pairs |= {(j, i) for j in holders.get(x, ())}
            holders.setdefault(x, []).append(i)
    links = 0
    for i, j in sorted(pairs):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            links += a != b
            root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted(low.values()), links


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, links = plain_kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == want
    return links


@pytest.mark.parametrize("long, tile", [(near_copies.LONG, near_copies.TILE), (9, 7)])
def test_planted_near_copies(spark, monkeypatch, long, tile):
    monkeypatch.setattr(near_copies, "LONG", long)
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(20)
    words = [f"w{i}" for i in range(2000)]
    line = rng.choices(words, k=30)
    texts = [rng.choices(words, k=rng.choice([1, 3, 5, 6, 9, 40, 200, 600])) + line * rng.randrange(2) for _ in range(60)]
    for base in texts[:40]:
        for edits in (0, 1, 2, 3, 5, 8, 13, 21):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = rng.choice(words)
            texts.append(copy[: len(copy) - rng.choice([0, 0, len(copy) // 12])])
    group = rng.choices(words, k=150)  # copies near the first, and mostly not near each other
    for _ in range(60):
        copy = list(group)
        for at in rng.sample(range(150), 3):
            copy[at] = rng.choice(words)
        texts.append(copy)
    rng.shuffle(texts)
    assert check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]) > 200


def test_documents_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.01").collect()]
    assert check(spark, rows) >= 5


def test_groups_whose_copies_are_near_the_base_only(spark, monkeypatch):
    """Large groups: a base, copies near it and mostly not near each other, and copies near other copies only."""
    monkeypatch.setattr(near_copies, "LONG", 12)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]

    def edited(base, n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), n):
            copy[at] = rng.choice(words)
        return copy

    texts = []
    for length in (120, 300):
        base = rng.choices(words, k=length)
        near = [edited(base, length // 50) for _ in range(80)]
        texts += [base, *near, *(edited(x, length // 45) for x in near[:40])]
    rng.shuffle(texts)
    assert check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]) > 200


def test_a_passage_that_many_documents_share(spark):
    """Documents that differ but for one passage, which fills most of some of them, and near copies among those."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=200)
    texts = [passage + rng.choices(words, k=rng.choice([20, 40, 60, 100, 400])) for _ in range(300)]
    for base in texts[:60]:
        copy = list(base)
        copy[-1 - rng.randrange(20)] = "edited"
        texts.append(copy)
    rng.shuffle(texts)
    assert check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]) > 60


def test_columns_of_any_name(spark):
    names = ["row", "_row", "language", "score", "Keep", "posterior", "n", "fp", "class", "key", "root"]
    rows = [(i, "The cat sat on the mat and looked out of the window at the birds.", "en", *["x"] * len(names)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)
    assert near_copies.keep_one(df).count() == simhash.keep_one(df).count() == 1


def test_odd_rows(spark, odd_docs, no_docs):
    got = [r.doc_id for r in near_copies.keep_one(odd_docs).collect()]
    rows = [(10**6 if r.doc_id is None else r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(10**6 if i is None else i for i in got) == plain_kept(rows)[0]
    assert near_copies.keep_one(no_docs).count() == 0
    nameless = odd_docs.where("doc_id is null")
    assert near_copies.keep_one(nameless.unionByName(nameless)).count() == 1


def test_a_common_passage_takes_linear_work(spark, monkeypatch):
    """Texts of 120 common and 120 own words, no near copies: twice the texts, twice the rows that meet."""
    seen = {}
    plain = common.materialise

    def counted(df, name):
        out = plain(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(common, "materialise", counted)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(120)])) for i in range(1200)]
    work = []
    for n in (300, 600, 1200):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(4)
        assert near_copies.keep_one(df).count() == n
        work.append(sum(seen[k] for k in ("near-keys", "near-buckets", "near-long", "near-pairs-first", "near-pairs-second", "near-groups", "near-left")))
    assert work[1] <= 2.5 * work[0] + 100 and work[2] <= 2.5 * work[1] + 100 and work[2] < 1200


def test_prefixes_of_all_similar_pairs_meet():
    for n in range(1, 60):
        for m in range(n, 80):
            least = -(-4 * (n + m) // 9)
            if least > n:
                break
            # The worst case: what is not shared comes first in both orders.
            assert n - least + 1 <= near_copies.prefix_length(n) and m - least + 1 <= near_copies.prefix_length(m)
