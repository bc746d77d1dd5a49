"""Hash trees, the shared chunk store and scans by range, on small inputs and random histories."""

import hashlib
import os
import random
import resource

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import hash_tree
from tallyforge.operators import manifest as mf
from tallyforge.sources import chunk_store, objects, ranges, tables


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, held):
    return spark.createDataFrame(sorted(held.items()), "path string, hash string")


def as_dict(tree, version=None):
    rows = tree.entries(version).collect()
    assert len(rows) == len({r.path for r in rows})
    return {r.path: r.hash for r in rows}


def test_hash_tree_follows_random_changes(spark, tmp_path):
    rng, held = random.Random(5), {f"p/{k}": sha(str(k)) for k in range(60)}
    tree = hash_tree.HashTree(spark, str(tmp_path / "t")).build(frame(spark, held), depth=2)
    states = [dict(held)]
    for step in range(3):
        gone = rng.sample(sorted(held), 12)
        changes = {p: None for p in gone[:6]} | {p: sha(f"{p}{step}") for p in gone[6:]} | {f"n/{step}-{k}": sha(f"n{k}") for k in range(4)}
        tree.update(spark.createDataFrame(sorted(changes.items()), "path string, hash string"))
        held = {p: h for p, h in (held | changes).items() if h}
        states.append(dict(held))
        assert as_dict(tree) == held
    assert as_dict(tree, 2) == states[1]
    anew = hash_tree.HashTree(spark, str(tmp_path / "anew")).build(frame(spark, held), depth=2)
    assert tree.root().first() == anew.root().first() and tree.root().first().entries == len(held)
    same = hash_tree.diff(tree, anew)
    assert same.nodes == 1 and same.rows.isEmpty()
    for a, c in ((1, 4), (4, 2)):  # two versions of one tree
        got = {tuple(r) for r in hash_tree.diff(tree, tree, a, c).rows.collect()}
        want = {tuple(r) for r in mf.diff(frame(spark, states[a - 1]), frame(spark, states[c - 1])).where("status <> 'same'").collect()}
        assert got == want and got


def test_hash_tree_reads_what_changed(spark, tmp_path):
    big = spark.range(200_000).select(F.format_string("p/%06d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    tree = hash_tree.HashTree(spark, str(tmp_path / "t")).build(big)
    assert tree.depth == hash_tree.depth_for(200_000) == 3
    tree.update(spark.createDataFrame([("p/000007", "x"), ("p/100000", None), ("q", "y")], "path string, hash string"))
    found = hash_tree.diff(tree, tree, 1, 2)
    assert sorted((r.path, r.status) for r in found.rows.collect()) == [("p/000007", "mismatch"), ("p/100000", "missing"), ("q", "extra")]
    assert found.nodes <= 1 + 3 * 16 * tree.depth  # of 4,369
    second = tree._commit(2)["data"]
    assert spark.read.parquet(f"{second}/entries").count() < 1000 and spark.read.parquet(f"{second}/nodes/3").count() == 3


def test_hash_tree_edges(spark, tmp_path):
    none = hash_tree.HashTree(spark, str(tmp_path / "none")).build(frame(spark, {}))
    assert none.root().first().asDict() == {"root": None, "entries": 0}
    none.update(frame(spark, {"a": "1"}))
    one = hash_tree.HashTree(spark, str(tmp_path / "one")).build(frame(spark, {"a": "1"}))
    assert none.root().first() == one.root().first() and hash_tree.diff(none, one).rows.isEmpty()
    one.update(spark.createDataFrame([("a", None)], "path string, hash string"))
    assert one.root().first().entries == 0 and [tuple(r) for r in hash_tree.diff(none, one).rows.collect()] == [("a", "missing", "1", None)]
    deep = hash_tree.HashTree(spark, str(tmp_path / "deep")).build(frame(spark, {"a": "1"}), depth=1)
    with pytest.raises(ValueError, match="depth"):
        hash_tree.diff(one, deep)
    with pytest.raises(tables.Conflict):
        one._write(one._newest("entries", 1, "leaf", [""]), None, 0, 1)  # version 2 is there


def test_hash_tree_beyond_the_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_tree, "LISTED", 3)
    held = {f"p/{k}": sha(str(k)) for k in range(80)}
    a = hash_tree.HashTree(spark, str(tmp_path / "a")).build(frame(spark, held), depth=2)
    c = hash_tree.HashTree(spark, str(tmp_path / "c")).build(frame(spark, held), depth=2)
    c.update(frame(spark, {p: "new" for p in list(held)[:30]}))
    assert {r.path for r in hash_tree.diff(a, c).rows.collect()} == set(list(held)[:30])


def objs(spark, held):
    return spark.createDataFrame([(p, 0o644, bytearray(c)) for p, c in sorted(held.items())], "path string, mode int, content binary")


def restored(store, archive_id):
    rows = objects.restore(store.archive(archive_id)).collect()
    assert all(r.error is None for r in rows)
    return {r.path: bytes(r.content) for r in rows}


def test_chunk_store_writes_new_chunks_only(spark, tmp_path):
    store = chunk_store.ChunkStore(spark, str(tmp_path / "s"), 4)
    first = {"a": b"aaaabbbb", "b": b"aaaacc", "empty": b""}
    assert store.export(objs(spark, first), "x").first().asDict() == {"logical_bytes": 14, "blocks": 4, "chunks": 3, "new_chunks": 3, "new_bytes": 10}
    second = first | {"b": b"aaaadd"}
    assert store.export(objs(spark, second), "y").first().asDict() == {"logical_bytes": 14, "blocks": 4, "chunks": 3, "new_chunks": 1, "new_bytes": 2}
    assert store.export(objs(spark, second), "again").first().new_chunks == 0
    assert restored(store, "x") == first and restored(store, "y") == second == restored(store, "again")
    uses = {r.hash: (r.archives, r.uses) for r in store.references().collect()}
    assert uses[sha("aaaa")] == (3, 6) and uses[sha("cc")] == (1, 1) and uses[sha("dd")] == (2, 2)
    with pytest.raises(ValueError, match="in the store"):
        store.export(objs(spark, first), "x")
    with pytest.raises(KeyError):
        store.remove("absent")
    for name in ("x", "y", "again"):
        store.remove(name)
    assert {r.archives for r in store.references().collect()} == {0}
    assert store.sweep().first().removed == 4 and store.references().isEmpty()
    assert store.vacuum() == []  # too young
    assert len(store.vacuum(0)) == 2 + 3 and store.vacuum(0) == []
    assert store.export(objs(spark, {}), "none").first().asDict() == {"logical_bytes": 0, "blocks": 0, "chunks": 0, "new_chunks": 0, "new_bytes": 0}


def test_chunk_store_keeps_chunks_in_use(spark, tmp_path):
    rng, store, live = random.Random(3), chunk_store.ChunkStore(spark, str(tmp_path / "s"), 2), {}
    for step in range(8):
        kind = rng.choice(("export", "export", "remove", "sweep")) if live else "export"
        if kind == "export":
            live[f"a{step}"] = {f"f{k}": bytes(rng.choice(b"abc") for _ in range(rng.randrange(9))) for k in range(4)}
            store.export(objs(spark, live[f"a{step}"]), f"a{step}")
        elif kind == "remove":
            name = rng.choice(sorted(live))
            store.remove(name)
            del live[name]
        else:
            store.sweep()
            store.vacuum(0)
            assert store.references().where("archives = 0").isEmpty()
    for name, held in live.items():
        assert restored(store, name) == held


def test_chunk_store_export_during_a_sweep(spark, tmp_path, monkeypatch):
    store = chunk_store.ChunkStore(spark, str(tmp_path / "s"), 4)
    store.export(objs(spark, {"a": b"aaaabbbb"}), "x")
    store.remove("x")
    plain, calls = chunk_store.ChunkStore._publish, []

    def publish(self, base, held):
        if not calls:
            calls.append(1)
            other = chunk_store.ChunkStore(spark, str(tmp_path / "s"), 4)
            assert other.sweep().first().removed == 2  # the export under way counts on these
        return plain(self, base, held)

    monkeypatch.setattr(chunk_store.ChunkStore, "_publish", publish)
    assert store.export(objs(spark, {"b": b"aaaacccc"}), "y").first().new_chunks == 2
    store.vacuum(0)
    assert restored(store, "y") == {"b": b"aaaacccc"}


def test_ranged_blocks_equal_whole_files(spark, tmp_path):
    rng = random.Random(1)
    for name, size in (("a", 0), ("d/b", 1), ("d/c", 64), ("e", 1000), (".kept/x", 5)):
        at = tmp_path / "t" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(rng.randbytes(size))
    root = str(tmp_path / "t")
    assert {r.path for r in objects.tree(spark, root).collect()} == {"a", "d/b", "d/c", "e"}
    assert {r.path for r in objects.tree(spark, root, ("d/",), hidden=True).collect()} == {"a", "e", ".kept/x"}
    assert {r.path for r in ranges.blocks(spark, root, 64, skip_prefixes=("d/",), hidden=True).collect()} == {"e", ".kept/x"}
    whole = objects.tree(spark, root).select("path", F.lit(0o644).alias("mode"), "content")
    for span in (1, 100, 1 << 20):
        got = ranges.blocks(spark, root, 64, keep_data=True, span=span)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, objects.blocks(whole, 64, keep_data=True).select("path", "offset", "length", "hash", "data").collect()))
    made, want = (sorted(map(str, df.collect())) for df in (ranges.index(spark, root, 64), objects.object_index(whole, objects.blocks(whole, 64))))
    assert made == want and any("path='a'" in r for r in made)


def test_ranged_blocks_of_a_large_file(spark, tmp_path):
    """3 GB, which no row can hold, in tasks of some megabytes."""
    (tmp_path / "t").mkdir()
    with open(tmp_path / "t" / "big", "wb") as f:
        f.truncate(3 << 30)
        f.seek((3 << 30) - 5)
        f.write(b"tail!")
    held = ranges.blocks(spark, str(tmp_path / "t"), 1 << 20)
    row = held.agg(F.count("*"), F.sum("length"), F.count_distinct("hash")).first()
    assert tuple(row) == (3 << 10, 3 << 30, 2)
    peak = spark.range(8, numPartitions=8).mapInPandas(lambda it: (b.assign(id=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) for b in it), "id long").agg(F.max("id")).first()[0]
    assert peak < 600 * 1024  # KB, of the workers that read it


def test_ranged_blocks_of_a_file_that_shrank(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f").write_bytes(os.urandom(300))
    found = ranges.blocks(spark, str(tmp_path / "t"), 64)
    (tmp_path / "t" / "f").write_bytes(os.urandom(100))
    with pytest.raises(Exception, match="is shorter than 300 bytes now"):
        found.collect()
