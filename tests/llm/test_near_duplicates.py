"""SimHash and pivot index against brute force over all pairs; components against union-find."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import common, components, pivots, simhash


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    run = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(run[i : i + words]) for i in range(len(run) - words + 1)] if len(run) >= words else [" ".join(run)] if run else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("docs", ["odd_docs", "some_docs", "no_docs"])
def test_simhash(request, docs):
    df = request.getfixturevalue(docs)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
    root = classes(len(rows), links)
    low = {}
    for (i, _), c in zip(rows, root, strict=True):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    want = sorted((str(i), f"{f:016x}", str(low.get(c))) for (i, f), c in zip(rows, root, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == want
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(root))
    assert {r.doc_id for r in kept} >= set(low.values())


@pytest.mark.parametrize("bucket", [8, 1024])
def test_links_keep_components_with_any_bucket(spark, bucket):
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for seed in list(fps)[:6]:
        for _ in range(40):
            x = seed
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6])):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 2**64 - 1, 1 << 63, 7, 15}
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket).collect()
    place = {x: i for i, x in enumerate(signed)}
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert all((fps[place[r.a]] ^ fps[place[r.b]]).bit_count() <= 3 for r in found)
    assert classes(len(fps), [(place[r.a], place[r.b]) for r in found]) == classes(len(fps), want)


def test_every_close_pair_shares_a_chain_key():
    rng = random.Random(1)
    chain = simhash.chains()
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << p
        shared = [start for start, mask in chain if a & mask == b & mask]
        assert any(simhash.within_chain(np.array([a], np.uint64), np.uint64(b), s)[0] for s in shared)
        for start, mask in chain:
            if a & mask == b & mask:
                assert any(a & m == b & m for s, m in simhash.cut_further([(start, mask)]))


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(60)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 5), (7, 7)], "a long, b long")
    root = classes(400, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components.components(df, "a", "b").collect()
    assert {(r.node, r.root) for r in got} == {(x, root[x]) for x in nodes} and len(got) == len(nodes)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_links(rows, threshold=0.98):
    def usable(r):
        return r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(x != 0 for x in r[2])

    out = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    out.append((i, j))
    return out


def check_vectors(got, rows, least=1.0):
    want = plain_links(rows)
    root = classes(len(rows), want)
    low = {}
    for r, c in zip(rows, root, strict=True):
        low[c] = min(r[0], low.get(c, r[0]))
    n = np.bincount(np.array(want).reshape(-1).astype(int), minlength=len(rows))
    expected = {r[0]: (int(k), low[c], r[0] == low[c]) for r, k, c in zip(rows, n, root, strict=True)}
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert found.keys() == expected.keys() and len(got) == len(rows)
    if least == 1:
        assert found == expected
    assert all(found[k][0] <= expected[k][0] for k in expected)
    assert sum(v[0] for v in found.values()) >= least * sum(v[0] for v in expected.values())


def planted_vectors(dimensions, pairs, cosine=0.981, alone=1500, seed=1):
    """(vec_id, label, vector): pairs at just this cosine, and vectors without a partner."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(pairs, dimensions)))
    u = rng.normal(size=x.shape)
    y = cosine * x + np.sqrt(1 - cosine**2) * unit(u - (u * x).sum(1, keepdims=True) * x)
    rest = unit(rng.normal(size=(alone, dimensions)))
    labels = np.concatenate((np.arange(pairs) % 4, np.arange(pairs) % 4, rng.integers(0, 4, alone)))
    v = np.concatenate((x, y, rest)).astype(np.float32)
    order = rng.permutation(len(v))
    return [(int(i), int(labels[k]), v[k].tolist()) for i, k in enumerate(order)]


def linked_by_matrix(rows, threshold=0.98):
    """n_links and component_id of every row, by label from the whole matrix of cosines."""
    out, links = {}, 0
    for label in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == label]
        v = np.array([r[2] for r in own], dtype=np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        hit = np.triu(v @ v.T >= threshold, 1)
        i, j = np.nonzero(hit)
        links += len(i)
        root = classes(len(own), list(zip(i.tolist(), j.tolist(), strict=True)))
        low = {}
        for r, c in zip(own, root, strict=True):
            low[c] = min(r[0], low.get(c, r[0]))
        n = hit.sum(1) + hit.sum(0)
        out |= {r[0]: (int(k), low[c]) for r, k, c in zip(own, n, root, strict=True)}
    return out, links


@pytest.mark.parametrize("dimensions", [64, 384])
def test_recall_on_planted_near_copies(spark, dimensions):
    rows = planted_vectors(dimensions, 3000)
    want, links = linked_by_matrix(rows)
    assert links >= 3000
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = [{r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(d).collect()} for d in (df.repartition(3), df.repartition(7))]
    assert found[0] == found[1]  # whatever the partitions
    got = found[0]
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * 2 * links
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.99


@pytest.mark.parametrize("spread", [0.02, 0.09])
def test_a_dense_cluster(spark, monkeypatch, spread):
    """Tight: a core counts itself.  Loose: tiles find what brute force finds, if pairs of the cluster link in part."""
    monkeypatch.setattr(pivots, "TILE", 300)
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    v = (base + rng.normal(size=(1200, 64)) * spread / 8).astype(np.float32)
    rows = [(i, 1, x.tolist()) for i, x in enumerate(v)] + [(5000 + i, 1, rng.normal(size=64).astype(np.float32).tolist()) for i in range(50)]
    want, links = linked_by_matrix([(i, label, np.float64(np.float32(x)).tolist()) for i, label, x in rows])
    assert links > 100_000
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert got == want


def test_shared_counts_and_lists():
    a = np.array([[1, 2, 3], [4, 5, 6], [7, -1, -1]], np.int16)
    b = np.array([[3, 1, 9], [7, -1, -1]], np.int16)
    assert pivots.shared_counts(a, b).tolist() == [[2, 0], [0, 0], [0, 1]]
    assert pivots.once(a, b, 1, 2).tolist() == [[True, False], [False, False], [False, False]]
    assert pivots.once(a, b, 3, 2).tolist() == [[False, False], [False, False], [False, False]]  # 1 holds both and comes first
    units = pivots.unit_rows(np.array([[1.0, 0.1], [-0.2, 1.0]]))
    assert pivots.prefixes(units, np.array([[0.0, 1.0], [1.0, 0.0]]), 3).tolist() == [[1, 0, -1], [0, 1, -1]]


@pytest.mark.parametrize("cosine, most", [(0.0, 0.005), (0.8, 0.02), (0.87, 0.02), (0.92, 0.03)])
def test_a_narrow_cone_is_told_apart(cosine, most):
    """Vectors with a mean cosine: few pairs are compared, and those at the threshold are found."""
    rng = np.random.default_rng(12)
    noise = pivots.unit_rows(rng.normal(size=(6000, 128)))
    centre = pivots.unit_rows(rng.normal(size=(1, 128)))
    x = pivots.unit_rows(np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * noise)
    z = rng.normal(size=x.shape)
    z = pivots.unit_rows(z - (z * x).sum(1)[:, None] * x)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * z
    index = pivots.Index(x[:2048], 256, 0.98)
    a, b = index.describe(x), index.describe(y)
    meet = (b[:, : index.lists] == a[:, :1]).any(1) | (a[:, : index.lists] == b[:, :1]).any(1)
    shared = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2).sum(1)
    assert (meet & (shared >= index.shared)).mean() >= 0.99
    some = a[:1500]
    met = np.zeros((1500, 1500), bool)
    for k in range(index.lists):
        met |= some[:, k, None] == some[None, :, 0]
    met = (met | met.T) & (pivots.shared_counts(some, some) >= index.shared)
    assert met[np.triu_indices(1500, 1)].mean() <= most, (index.lists, index.shared)


def test_pivot_index_on_tables(spark, sf_dir):
    """These tables hold no links at this threshold, so none must be found; recall is measured on planted vectors above."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in df.collect()]
    check_vectors(pivots.near_duplicates(df).collect(), rows)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", 4)
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    base = rng.normal(size=6)
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [2.0, 0.0]), (4, 2, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 1, None), (7, 1, []), (8, 1, [0.0, 0.0]), (9, 1, [1.0, nan]), (10, 1, [inf, 1.0]), (11, 1, [None, 1.0]), (12, 1, [0.98, 0.19899748742132398]), (13, 1, [1.0, 0.0, 0.0])]
    rows += [(100 + i, 3, (base + rng.normal(size=6) * 0.02).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame([(*r, r[0], "x") for r in rows], "vec_id long, label int, embedding array<float>, class long, place string")
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    check_vectors(pivots.near_duplicates(df).collect(), rows)
    assert pivots.near_duplicates(df.limit(0)).count() == 0
    twice = pivots.near_duplicates(df.where("vec_id in (1, 4)").unionByName(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long")))).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in twice) == [("1", 1, 1, True), ("4", 0, 4, True), ("None", 1, 1, False)]


def test_groups_across_batches(spark):
    import pyarrow as pa

    df = spark.range(5000).select((F.col("id") % 37).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = components.by_group(df, ["k"], lambda rows: iter([pa.RecordBatch.from_arrays([rows["k"][:1], pa.array([len(rows["id"])], pa.int64())], names=["k", "n"])]), "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in got) == [(k, len(range(k, 5000, 37))) for k in range(37)]


def test_materialised_tables_lie_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    made = common.shared_dir(spark, "x")
    assert made.startswith(base if ":" in base else f"file:{base}")  # always with its scheme
