"""Logs, folds, objects, archives and rules on small inputs with answers worked out by hand or by hashlib."""

import concurrent.futures
import hashlib
import json
import os
import random
import shutil
import subprocess
import sys
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import replay_fold
from tallyforge import schema
from tallyforge.functions import digests, rules, text
from tallyforge.operators import catalog, dedup, log_ops, series
from tallyforge.operators import manifest as mf
from tallyforge.sources import log, objects, segments, tables
from tallyforge.streaming import state, stream


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def line(record, crc=True):
    body = json.dumps(record, separators=(",", ":"))
    return body + (f"\t#crc32={zlib.crc32(body.encode()):08x}" if crc else "")


def test_log_scan_flags_damage(spark, tmp_path):
    good = {"seq": 1, "epoch": 1, "kind": "write", "path": "a", "size": 3}
    summed = dict(good, seq=4)
    summed["entry_checksum"] = sha(json.dumps(summed, separators=(",", ":")))
    lines = [line(good), line(dict(good, seq=2), crc=False), "", line(dict(good, seq=3))[:-1] + "z", line(summed), line(dict(summed, size=9)), "garbage", line(dict(good, seq=7, kind="odd"))]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    rows = {r.seq: r for r in log.scan(spark, str(tmp_path), strict=False).collect() if r.parse_ok}
    assert rows[1].crc_ok and rows[2].crc_ok and not rows[3].crc_ok and rows[7].kind_known is False and rows[1].kind_known
    flagged = [(r.crc_ok, r.parse_ok, r.checksum_ok) for r in log.parse(spark.read.text(str(tmp_path))).where("seq = 4").collect()]
    assert sorted(flagged) == [(True, True, False), (True, True, True)]
    assert not log.parse(spark.read.text(str(tmp_path))).where("raw = 'garbage'").first().parse_ok
    with pytest.raises(Exception, match="damaged log line"):
        log.scan(spark, str(tmp_path)).collect()
    (tmp_path / "log").write_text("\n".join(line(dict(good, seq=k)) for k in range(1, 9)) + "\n")
    assert [r.seq for r in log.scan(spark, str(tmp_path), 3, 5).orderBy("seq").collect()] == [3, 4, 5]


def test_torn_tail(spark, tmp_path):
    texts = {"a": "x\ny\nz", "b": "x\ny\n", "c": "long line without end", "d": "", "e": "é\n\n{\"half\": ", "f": "".join(f"line {i}\n" for i in range(40_000)) + "torn"}
    wants = {"a": ["x", "y"], "b": ["x", "y"], "c": [], "d": [], "e": ["é", ""], "f": [f"line {i}" for i in range(40_000)]}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # the largest file is read in several blocks
    try:
        for name, data in texts.items():
            (tmp_path / name).write_text(data)
            assert [r.value for r in log.whole_lines(spark, str(tmp_path / name)).orderBy("block", "line_no").collect()] == wants[name]
        together = log.whole_lines(spark, str(tmp_path)).groupBy("file").count().collect()
        assert {r.file[-1]: r["count"] for r in together} == {k: len(v) for k, v in wants.items() if v}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_then_scan(spark, tmp_path):
    made = tables.generate_log(spark, 200, 12)
    log.write(made, str(tmp_path / "l"))
    again = log.scan(spark, str(tmp_path / "l"))
    columns = ["seq", "kind", "path", "size", "content_hash", "client_op_id"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, made.select(columns).collect()))
    assert log_ops.head(again).first().next_seq == 201


def mutations(spark, rows):
    names = ["seq", "resource", "kind", "path", "dest_path", "mode", "content_hash"]
    full = [dict(zip(names, r)) for r in rows]
    df = spark.createDataFrame([(x["seq"], x["resource"], x["kind"], x["path"], x["dest_path"], x["mode"], x["content_hash"], 0, 1) for x in full], "seq long, resource string, kind string, path string, dest_path string, mode int, content_hash string, offset long, size long")
    return df


def test_replay(spark):
    df = mutations(spark, [
        (1, "r", "write", "d/a", "", 0, "h1"), (2, "r", "create", "d/b", "", 0o600, "h2"), (3, "r", "rename", "d", "e", 0, ""), (4, "r", "chmod", "e/a", "", 0o700, ""), (5, "r", "delete", "e/b", "", 0, ""), (6, "r", "delete", "none", "", 0, ""),
        (1, "bad", "write", "x", "", 0, "h"), (2, "bad", "rename", "gone", "y", 0, ""), (3, "bad", "write", "z", "", 0, "h"),
        (1, "odd", "frobnicate", "x", "", 0, ""), (1, "tree", "write", "t/a", "", 0, "1"), (2, "tree", "write", "t/b/c", "", 0, "2"), (3, "tree", "write", "tt", "", 0, "3"), (4, "tree", "delete", "t", "", 0, ""),
    ])
    got = {}
    for r in log_ops.replay(df).collect():
        got.setdefault(r.resource, []).append((r.path, r.mode, r.content_hash, r.applied, r.error))
    assert got["r"] == [("e/a", 0o700, "h1", 6, None)]
    assert got["bad"] == [("x", 0o644, "h", 1, "no such path gone")]
    assert got["odd"] == [(None, None, None, 0, "unknown kind frobnicate")]
    assert got["tree"] == [("tt", 0o644, "3", 4, None)]


def test_replay_equals_latest_without_renames(spark):
    made = tables.generate_log(spark, 400, 15).where("kind in ('write', 'create', 'truncate', 'delete')")
    folded = {(r.path, r.content_hash) for r in log_ops.replay(made).collect()}
    newest = {(r.path, r.content_hash) for r in log_ops.latest(made, "path", "seq", "kind", "delete", ["content_hash"]).collect()}
    assert folded == newest and newest


def test_append_dedups_and_fences(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "seq long, client_op_id string, fence_token long").withColumn("epoch", F.lit(1).cast("long"))
    new = spark.createDataFrame([(1, "b", 5), (2, "c", 3), (3, "d", 6), (4, "d", 6), (5, "e", 0)], "arrival long, client_op_id string, fence_token long").withColumn("epoch", F.lit(1).cast("long"))
    assert sorted((r.seq, r.client_op_id, r.fence_token) for r in log_ops.append(base, new).collect()) == [(3, "d", 6), (4, "e", 5)]
    # A refused record does not stand in the way of its retry, and equal rows are one record.
    again = spark.createDataFrame([(1, "a2", 1), (2, "a2", 7), (3, "f", 5), (3, "f", 5), (3, "", 5), (3, "", 5)], "arrival long, client_op_id string, fence_token long")
    got = sorted((r.seq, r.client_op_id, r.fence_token, r.epoch) for r in log_ops.append(base, again).collect())
    assert got[0] == (3, "a2", 7, 1) and [x[0] for x in got] == [3, 4, 5, 6] and sorted(x[1:] for x in got[1:]) == [("", 5, 1), ("", 5, 1), ("f", 5, 1)]
    assert [r.fence_token for r in log_ops.append(base, again, fence=0).where("client_op_id = 'a2'").collect()] == [1]  # no fence at all


def test_latest_is_one_row_a_key(spark):
    rows = spark.createDataFrame([("a", 2, 1, "write", "x"), ("a", 2, 2, "write", "y"), ("b", 2, 1, "write", "x"), ("b", 2, 2, "delete", ""), ("c", 2, 1, "delete", ""), ("c", 2, 2, "write", "z"), ("d", 1, 9, "delete", ""), ("d", 3, 1, "write", "w"), ("d", 3, 1, "write", "w")], "k string, seq long, line long, kind string, v string")
    args = ("k", "seq", "kind", "delete", ["v"])
    assert sorted(map(tuple, log_ops.latest(rows, *args, tie="line").collect())) == [("a", 2, "write", "y"), ("c", 2, "write", "z"), ("d", 3, "write", "w")]
    assert sorted(map(tuple, log_ops.latest(rows, *args).collect())) == [("a", 2, "write", "y"), ("b", 2, "write", "x"), ("c", 2, "write", "z"), ("d", 3, "write", "w")]


def test_one_first_of_an_op(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("", 1), (None, 1), ("b", 3)], "client_op_id string, seq long")
    got = log_ops.first_of_op(rows).groupBy("client_op_id").agg(F.count_if("is_first").alias("n"), F.min("effective_seq").alias("s")).collect()
    assert {r.client_op_id: (r.n, r.s) for r in got} == {"a": (1, 1), "": (1, 1), None: (1, 1), "b": (1, 3)}


def test_epochs(spark):
    df = spark.createDataFrame([("x", 1, "commit", 0), ("x", 2, "commit", 0), ("x", 3, "advance", 1), ("x", 4, "rollback", 1), ("x", 5, "advance", 7), ("x", 6, "force", 2)], "d string, at long, what string, e long")
    got = sorted((r.at, r.assigned, r.refused) for r in log_ops.epochs(df, "d", "at", "what", "e").collect())
    assert got == [(1, 1, False), (2, 2, False), (3, 2, True), (4, 1, False), (5, 7, False), (6, 2, False)]


def test_epochs_equal_a_fold(spark):
    rng = random.Random(8)
    rows = [(f"k{k % 3}", k, rng.choice(["commit", "commit", "advance", "rollback", "force"]), rng.randrange(12)) for k in range(200)]
    now, want = {}, {}
    for key, at, what, to in rows:
        was = now.get(key, 0)
        refused = what == "advance" and to < was
        now[key] = was + 1 if what == "commit" else was if refused else to
        want[key, at] = now[key], refused
    df = spark.createDataFrame(rows, "d string, at long, what string, e long")
    assert {(r.d, r.at): (r.assigned, r.refused) for r in log_ops.epochs(df, "d", "at", "what", "e").collect()} == want


@pytest.mark.parametrize("renames", [True, False])
def test_replay_of_random_logs_equals_a_flat_map(spark, renames):
    rng = random.Random(11)
    names = [f"{a}/{b}" for a in "abc" for b in "xyz"] + ["a", "b", "c", "a/x/1", "a/x/2"]
    leaves = [n for n in names if not any(m.startswith(n + "/") for m in names)]
    rows, want = [], {}
    for run in range(40):
        state, applied, stopped = {}, 0, False
        for seq in range(25):
            kind = rng.choice(["write", "write", "write", "write", "delete", "chmod", *["rename"] * renames, *["frobnicate"] * (seq > 15)])
            path, dest = rng.choice(leaves if kind in ("write", "chmod") else names), rng.choice(["n/1", "m", "c/y"])
            if dest == path or kind == "chmod" and path not in state and rng.random() < 0.9:
                continue
            rows.append((seq, f"r{run}", kind, path, dest, seq if kind == "chmod" else 0, f"h{seq}"))
            if stopped:
                continue
            below = [p for p in state if p == path or p.startswith(path + "/")]
            if kind == "write":
                state[path] = f"h{seq}", 0o644
            elif kind == "frobnicate":
                stopped = True
            elif kind == "delete":
                for p in below:
                    del state[p]
            elif kind == "chmod":
                stopped = path not in state
                if not stopped:
                    state[path] = state[path][0], seq
            elif not below:
                stopped = True
            else:
                for p in below:
                    state[dest + p[len(path) :]] = state.pop(p)
            applied += not stopped
        want[f"r{run}"] = state, applied, stopped
    got = {}
    for r in log_ops.replay(mutations(spark, rows)).collect():
        held = got.setdefault(r.resource, ({}, r.applied, r.error is not None))
        if r.path is not None:
            held[0][r.path] = r.content_hash, r.mode
    assert got == want
    assert 5 < sum(stopped for _, _, stopped in want.values()) < 40


@pytest.mark.parametrize("seed", range(2))
def test_replay_of_nested_renames_equals_a_fold(spark, seed):
    """Folders renamed into, over and out of each other, objects that follow many renames, modes (also 0), and errors."""
    rng = random.Random(seed)
    parts = ["a", "b", "c"]
    rows = []
    for run in range(30):
        for seq in range(rng.choice([6, 14, 30])):
            kind = rng.choice(["write"] * 5 + ["rename"] * 4 + ["delete", "chmod", *["frobnicate"] * (rng.random() < 0.02)])
            path, dest = ("/".join(rng.choices(parts, k=rng.choice([1, 2, 2, 3]))) for _ in range(2))
            rows.append((seq, f"r{run}", kind, path, dest if kind == "rename" else "", rng.choice([0, 0, 0o600, 0o755]), f"h{seq}"))
    # Logs that no error cuts short, as most random renames have no source.
    for run in range(12):
        tree, at = replay_fold.Tree(), 0
        for seq in range(40):
            paths = [p for p, _ in tree.objects()]
            kind = rng.choice(["write", "write", "rename", "rename", "chmod", "delete"]) if paths else "write"
            path = "/".join(rng.choices(parts, k=rng.choice([1, 2, 3]))) if kind == "write" else rng.choice(paths)
            if kind in ("rename", "delete") and rng.random() < 0.5:
                path = path.rsplit("/", rng.choice([0, 1]))[0]
            record = (at, f"good{run}", kind, path, "/".join(rng.choices(parts, k=rng.choice([1, 2]))) if kind == "rename" else "", rng.choice([0, 0o640]), f"g{at}")
            rows.append(record)
            at += 1
            if kind == "write":
                tree.put(path, (0, "", 0))
            elif kind == "delete":
                tree.take(path)
            elif kind == "rename" and path != record[4]:
                tree.add(record[4], tree.take(path))
    df = mutations(spark, rows)
    got = {}
    for r in log_ops.replay(df).collect():
        got.setdefault(r.resource, []).append((r.path, r.mode, r.content_hash, r.size, r.applied, r.error))
    want = {k: list(replay_fold.apply(g)) for k, g in df.toPandas().groupby("resource")}
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert all(v[0][5] is None and v[0][4] == 40 for k, v in want.items() if k.startswith("good"))


def test_replay_of_one_object_that_moves_often(spark):
    rows = [(0, "r", "write", "a", "", 0, "h")] + [(k, "r", "rename", "ab"[(k - 1) % 2], "ab"[k % 2], 0, "") for k in range(1, 8)] + [(9, "r", "chmod", "b", "", 0, ""), (9, "r", "write", "b", "", 0o600, "n")]
    assert [tuple(r) for r in log_ops.replay(mutations(spark, rows)).collect()] == [("r", "b", 0o600, "n", 1, 10, None)]


def test_log_sink_appends_once(spark, tmp_path):
    schema_ = "seq long, epoch long, fence_token long, client_op_id string"
    sink = log_ops.LogSink(spark, str(tmp_path / "log"), schema_)
    batch = lambda *ops: spark.createDataFrame([(k, 1, 0, op) for k, op in enumerate(ops)], "arrival long, epoch long, fence_token long, client_op_id string")
    sink.write(batch("a", "b"), 0)
    sink.write(batch("b", "c", "c", "d"), 1)
    sink.write(batch("b", "c", "c", "d"), 1)  # the batch comes again after a failure
    assert sorted((r.seq, r.client_op_id) for r in sink.read().collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    again = log_ops.LogSink(spark, str(tmp_path / "log"), schema_)
    again.write(batch("e", ""), 2)
    assert sorted((r.seq, r.client_op_id) for r in again.read().where("seq > 4").collect()) == [(5, "e"), (6, "")]


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "s"), schema.FENCE, "resource")
    assert store.load().count() == 0
    store.put(spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, "y")], schema.FENCE))
    store.put(spark.createDataFrame([("b", 2, 1, "z")], schema.FENCE))
    assert {tuple(r) for r in store.load().collect()} == {("a", 1, 1, "x"), ("b", 2, 1, "z")} and store.get("b").first().holder == "z"
    with pytest.raises(ValueError, match="twice"):
        store.put(spark.createDataFrame([("c", 1, 1, "x"), ("c", 1, 2, "y")], schema.FENCE))
    (tmp_path / "s" / "data" / "unfinished").mkdir()  # a write that did not finish
    assert store.load().count() == 2 and store.delete("a").count() == 1
    with pytest.raises(KeyError):
        store.delete("zz")
    points = tables.Store(spark, str(tmp_path / "p"), schema.RECOVERY_POINT, "id")
    points.put(spark.createDataFrame([("p1", datetime(2024, 1, 1), 3, 9, "x", "r", "SNAPSHOT", "")], schema.RECOVERY_POINT))
    assert points.get("p1").first().journal_position == 9


def test_fixtures(spark):
    for kind, parts in tables.FIXTURES.items():
        rows = tables.fixture(spark, kind).collect()
        assert len(rows) == sum(n for _, n, _ in parts) == len({r.path for r in rows})
    stats = dedup.stats(objects.blocks(tables.fixture(spark, "append-log"), 4096)).first()
    assert stats.logical_bytes == 3 * 98304 and stats.chunks == 1
    assert json.loads(bytes(tables.fixture(spark, "key-value").orderBy("path").first().content)) == {"id": 0, "value": "v0"}


def test_slots(spark):
    df = spark.createDataFrame([("a", "active"), ("b", "shadow"), ("c", "standby")], "slot string, role string")
    assert {r.slot: r.role for r in log_ops.promoted(df, "slot", "role", "b").collect()} == {"a": "standby", "b": "active", "c": "standby"}


@pytest.mark.parametrize("n_blocks", [0, 1, 2, 3, 17])
def test_archive_round_trip(spark, tmp_path, n_blocks):
    rng = random.Random(n_blocks)
    data = rng.randbytes(64 * n_blocks - (5 if n_blocks else 0)) if n_blocks else b""
    objs = spark.createDataFrame([("p/one", 0o600, data), ("p/two", 0o644, data), ("empty", 0o644, b""), ("s", 0o644, b"short")], "path string, mode int, content binary")
    a = objects.export(objs, str(tmp_path / "a"), "id-1", 3, 64)
    back = {r.path: (r.mode, bytes(r.content)) for r in objects.restore(a).collect()}
    assert back == {"p/one": (0o600, data), "p/two": (0o644, data), "empty": (0o644, b""), "s": (0o644, b"short")}
    assert objects.drill(a, 64).first().digest_ok
    s = a["summary"].first()
    assert s.logical_bytes == 2 * len(data) + 5 and s.saved_bytes == len(data) and s.epoch == 3
    c = objects.clone(a, str(tmp_path / "c"), "id-2")
    assert c["summary"].first().archive_id == "id-2" and c["summary"].first().root == s.root
    listed = a["objects"].select(F.explode("chunk_ids").alias("hash"))
    assert dedup.chunk_faults(listed, a["chunks"]).count() == dedup.reference_faults(a["objects"], a["chunks"]).count() == 0
    gone = a["chunks"].where(F.col("hash") != sha(b"short"))
    assert [tuple(r) for r in dedup.chunk_faults(listed, gone).collect()] == [(sha(b"short"), "missing")]
    assert [r.fault for r in dedup.reference_faults(a["objects"], gone).collect()] == ["missing_chunk"]
    bad = a["chunks"].withColumn("data", F.when(F.col("hash") == sha(b"short"), F.lit(b"other")).otherwise(F.col("data")))
    assert [r.fault for r in dedup.chunk_faults(listed, bad).collect()] == ["mismatch"]
    faults = lambda chunks: {r.path: (r.error, r.content is None) for r in objects.restore(a | {"chunks": chunks}).collect() if r.error}
    assert faults(gone) == {"s": ("missing chunk", True)} and faults(bad) == {"s": ("damaged chunk", True)}
    if n_blocks > 2:  # one of several chunks lost: an error, not a shorter object
        first = a["objects"].where("path = 'p/one'").first().chunk_ids[0]
        assert faults(a["chunks"].where(F.col("hash") != first)) == {"p/one": ("missing chunk", True), "p/two": ("missing chunk", True)}
        listed = {r.path: r.fault for r in objects.restore_blocks(a | {"chunks": a["chunks"].where(F.col("hash") != first)}).where("k = 0").collect()}
        assert listed["p/one"] == "missing chunk" and listed["s"] is None
        assert not objects.drill(a | {"chunks": gone}, 64).first().digest_ok
        with pytest.raises(Exception, match="cannot restore"):
            objects.sanitised_clone(a | {"chunks": gone}, str(tmp_path / "x"), "id-3", [text.redact_emails], 64)


def test_tree_scan(spark, tmp_path):
    for name, data in (("a/b.txt", b"1"), ("c.txt", b"22"), (".state/x", b"no")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = objects.tree(spark, str(tmp_path), (".state/",))
    assert sorted((r.path, r.length) for r in got.select("path", "length").collect()) == [("a/b.txt", 1), ("c.txt", 2)]
    assert mf.totals(got.select(F.col("length").alias("size"))).first().bytes == 3


def plain_merkle(leaves):
    row = [hashlib.sha256(x.encode()).digest() for x in leaves]
    while len(row) > 1:
        row = [hashlib.sha256(row[i] + row[i + 1]).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0].hex() if row else sha(b"")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_digests(spark, n):
    pairs = [(f"p{i:02d}ü", sha(str(i))) for i in range(n)]
    m = spark.createDataFrame(random.Random(n).sample(pairs, n), "path string, hash string")
    assert digests.merkle_root(m) == plain_merkle([f"{p}:{h}" for p, h in pairs])
    assert digests.root_digest(m).first().root == sha("".join(f"{p}:{h}\n" for p, h in pairs))
    flat = digests.flat_digest(m).first()
    assert flat.digest == sha("".join(f"{p}\0{h}\0" for p, h in pairs)) and flat.root == sha(flat.digest)
    assert digests.bucketed_root(m).first().root == digests.bucketed_root(m.repartition(3)).first().root


def test_digests_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(digests, "PIECE", 50)
    pairs = [(f"p{i:04d}", sha(str(i))) for i in range(300)]
    m = spark.createDataFrame(random.Random(1).sample(pairs, 300), "path string, hash string").repartition(7)
    assert digests.root_digest(m).first().root == sha("".join(f"{p}:{h}\n" for p, h in pairs))


def test_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session(), "x")


def test_seals(spark):
    df = digests.seal(spark.createDataFrame([(1, "x", None), (2, "y", 1.5)], "a int, b string, c double"))
    assert all(r.seal_ok for r in digests.sealed_ok(df).collect())
    assert not any(r.seal_ok for r in digests.sealed_ok(df.withColumn("b", F.lit("z"))).collect())


def test_manifest_equality_and_levels(spark):
    m = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "path string, hash string, size long")
    assert mf.equal(m, m).first().equal and not mf.equal(m, m.limit(1)).first().equal
    assert {r.status for r in mf.diff(m, m).collect()} == {"same"}
    outcome = lambda c, level="CHECKSUM", app=None: mf.verify(m, c, level, app).first().outcome
    changed = m.withColumn("hash", F.lit("9"))
    assert outcome(m) == "VERIFIED" and outcome(m, "METADATA") == "PARTIAL" and outcome(m, "whatever") == "UNKNOWN"
    assert outcome(changed) == "FAILED" and outcome(changed.where("path = 'a'").unionByName(m.where("path = 'b'"))) == "PARTIAL"
    assert outcome(m.limit(0)) == "PARTIAL" and outcome(m.unionByName(spark.createDataFrame([("z", "1", 1)], m.schema))) == "FAILED"
    assert outcome(m, "APPLICATION") == "UNKNOWN" and outcome(m, "APPLICATION", F.lit(True)) == "VERIFIED"
    assert outcome(changed, "APPLICATION", F.lit(True)) == "PARTIAL" and outcome(m, "APPLICATION", F.lit(False)) == "FAILED"


def test_tuning_equals_a_fold(spark):
    rng = random.Random(6)
    rows = [(k % 2, k, rng.choice([0, 200, 600]), rng.choice([50.0, 150.0]), rng.choice([0.0, 1.0]), rng.random(), rng.random(), rng.random()) for k in range(80)]
    df = spark.createDataFrame(rows, "g int, at int, lag int, w double, t double, cpu double, mem double, st double")
    got = {(r.g, r.at): r for r in series.tuning(df, ["g"], "at", "lag", "w", "t", "cpu", "mem", "st").collect()}
    state = {g: [64, False, 2, 1000] for g in (0, 1)}
    for g, at, lag, w, t, cpu, mem, st in rows:
        b, z, c, v = before = state[g]
        b = min(512, b * 2) if lag > 100 and cpu < 0.85 else b
        z = z or (w > 100 and t > 0)
        c = min(8, c + 1) if lag > 500 and mem < 0.8 else c
        v = v // 2 if st > 0.5 and v > 100 else v
        state[g] = [b, z, c, v]
        r = got[g, at]
        assert (r.batch, r.compression, r.concurrency, r.verify_every) == (b, z, c, v)
        assert [r.batch_changed, r.compression_changed, r.concurrency_changed, r.verify_every_changed] == [x != y for x, y in zip(state[g], before)]


def test_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    L = F.lit
    assert value(rules.is_verified(L(None).cast("string"))) is False and value(rules.is_ready(L("UNKNOWN"))) is False
    assert value(rules.is_recoverable(L("PARTIALLY_RECOVERABLE"))) is True and value(rules.gate_allows(L(None).cast("string"))) is False
    assert value(rules.is_stale_fence(L(2), L(3), L(2), L(4))) is True and value(rules.is_stale_fence(L(3), L(1), L(2), L(4))) is False
    assert value(rules.heat_class(L(10), L(2.0))) == "WARM" and value(rules.heat_class(L(10), L(2.0), True)) == "HOT"
    assert value(rules.live_pause_ms(L(10), L(0.0), L(50.0))) == 5 + 10_000 + 1
    assert value(rules.rollback_permitted(L("UNSAFE"), L(False), L("a"), L("a"))) is False and value(rules.rollback_permitted(L("SAFE"), L(False), L("a"), L("b"))) is False
    assert value(rules.looks_like_text(L("x.bin"), L(b"ab\0"))) is False and value(rules.looks_like_text(L("x.TXT"), L(b"ab\0"))) is True and value(rules.looks_like_text(L("x"), L(b"\x10\x02"))) is True
    good = {k: L(True) for k in ("candidate_ok", "manifest_ok", "journal_ok", "rollback_point", "coordinator_ok", "storage_ok")} | {"lag": L(0), "pending": L(0), "non_convergent": L(False), "outcome": L("VERIFIED"), "pause_ms": L(1.0), "unverified": L(0), "override": L(False)}

    def gate(**c):
        return one.select(*[x.alias(n) for x, n in zip(rules.gate(good | c), ("reasons", "decision", "strict"))]).first()

    assert gate().decision == "ALLOWED" and gate().reasons == []
    assert gate(outcome=L(None).cast("string")).decision == "BLOCKED" and gate(journal_ok=L(None).cast("boolean")).decision == "BLOCKED"
    assert gate(outcome=L("PARTIAL")).decision == "REQUIRES_OVERRIDE" and gate(outcome=L("PARTIAL"), override=L(True)).decision == "ALLOWED"
    lifted = gate(outcome=L("PARTIAL"), override=L(True), lag=L(9))
    assert lifted.decision == "ALLOWED" and lifted.strict == "BLOCKED" and lifted.reasons == ["lag", "partial"]
    assert gate(outcome=L("PARTIAL"), override=L(True), pause_ms=L(999.0)).decision == "BLOCKED"


def test_text_functions(spark):
    df = spark.createDataFrame([("a@b.io and password: \"x1\"", "warn")], "t string, level string")
    out = text.redact(df, "t", [text.redact_emails, text.tokenize_secrets]).first()
    kept = text.redact(df, "t", [text.redact_emails], F.lit(False)).first()
    assert kept.t == "a@b.io and password: \"x1\"" and not kept.changed
    assert out.t == "[REDACTED_EMAIL] and password: \"[TOKENIZED]\"" and out.changed
    row = df.select(text.event_line(F.col("level"), F.lit("m")).alias("l"), text.short_hash(F.lit("0123456789abcdef")).alias("h"), text.token_tail(F.lit("abcdefgh")).alias("t"), text.envelope(F.struct("level")).alias("e"), text.micros_to_ms(F.lit(1500)).alias("ms")).first()
    assert (row.l, row.h, row.t, row.e.schema_version, row.ms) == ("[!] m", "0123456789ab", "efgh", 1, 1.5)
    assert text.pause_metrics(spark.createDataFrame([(1, 2.0, 3.0)], "d int, w double, b double"), "w", "b").count() == 2


def test_catalog(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, at int")
    assert catalog.prune(df, "id", "a").count() == 1
    with pytest.raises(Exception, match="zz is not in the catalog"):
        catalog.prune(df, "id", "zz").collect()
    assert [r.id for r in catalog.newest_first(df, "at", "id").collect()] == ["b", "a"]
    expected = spark.createDataFrame([("s1", True, "RETRY"), ("s2", True, "ABORT"), ("s3", True, "ABORT")], "scenario string, expect_detection boolean, expect_action string")
    actual = spark.createDataFrame([("s1", True, True, "RETRY"), ("s2", True, True, "RETRY")], "scenario string, detected boolean, recovered boolean, action_taken string")
    assert {r.scenario: r.passed for r in catalog.chaos_matrix(expected, actual).collect()} == {"s1": True, "s2": False, "s3": False}
    points = spark.createDataFrame([("k", 2, 10), ("k", 1, 30)], "k string, epoch int, created int")
    wanted = spark.createDataFrame([("k", 2), ("k", 0), ("none", 5)], "k string, wanted int")
    got = lambda g: {(r.k, r.wanted): r.epoch for r in catalog.as_of(points, ["k"], wanted, "epoch", "created", "wanted", g).collect()}
    assert got(False) == {("k", 2): 1, ("k", 0): None, ("none", 5): None} and got(True)["k", 2] == 2


def test_state_machine(spark):
    steps = spark.createDataFrame(list(rules.STEPS), "from_phase string, to_phase string")
    history = spark.createDataFrame([("d", k, p) for k, p in enumerate([*rules.PHASES, "COMMITTED"])] + [("e", 0, "ACTIVE"), ("e", 1, "CUTOVER")], "id string, at int, phase string")
    assert [tuple(r) for r in series.illegal_steps(history, ["id"], "at", "phase", steps).collect()] == [("e", 1, "ACTIVE", "CUTOVER")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"archive_id": "a", "epoch": 3, "unknown": 1, "last_drill": {"receipt_id": "r", "digest_ok": True}}]))
    row = tables.read_json(spark, str(tmp_path / "c.json"), schema.CATALOG).first()
    assert row.archive_id == "a" and row.last_drill.digest_ok is True and row.verified is None
    tables.write_json(spark.createDataFrame([("n", 1.0)], "name string, value double"), str(tmp_path / "m"))
    assert tables.read_json(spark, str(tmp_path / "m"), schema.METRIC, multi_line=False).first().value == 1.0


def test_generators(spark):
    small = tables.generate(spark, "SMALL")
    assert small.count() == 20 and small.where("hot").count() == 4 and {len(r.content) for r in small.collect()} == {4096}
    assert [bytes(r.content) for r in small.orderBy("path").collect()] == [bytes(r.content) for r in tables.generate(spark, "SMALL").orderBy("path").collect()]


def test_a_stream_resumes_from_its_folder(spark, tmp_path):
    base = datetime(2024, 1, 1)

    def add(k):
        spark.createDataFrame([(k * 10 + i, f"u{i % 3}", float(i), base + timedelta(minutes=k * 10 + i)) for i in range(10)], "id long, u string, v double, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen, told = [], []
    listener = stream.Progress(lambda number, rows: told.append((number, rows)))
    spark.streams.addListener(listener)
    read = lambda: stream.read(spark, str(tmp_path / "in"), 1)
    run = lambda: stream.run_to_table(read().select("id"), "append", lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "run"))
    newest = lambda: stream.run_to_table(stream.latest(read(), "u", "id", ["v"]), "complete", folder=str(tmp_path / "newest"))
    for k in range(3):
        add(k)
    assert run().count() == 30 and seen == [(0, 10), (1, 10), (2, 10)]
    assert sorted((r.u, r.id) for r in newest().collect()) == [("u0", 29), ("u1", 27), ("u2", 28)]
    assert run().count() == 30 and len(seen) == 3  # nothing new
    add(3)
    assert run().count() == 40 and seen[3:] == [(3, 10)]  # only the new file
    assert sorted((r.u, r.id) for r in newest().collect()) == [("u0", 39), ("u1", 37), ("u2", 38)]
    once = stream.run_to_table(stream.first_of_op(read(), "u", "ts", "7 days"), "append", every="0 seconds")
    assert sorted(r.u for r in once.collect()) == ["u0", "u1", "u2"]
    spark.streams.removeListener(listener)
    assert sum(rows for _, rows in told) >= 70


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lww_state' in q and not [n for n in q if n.startswith('op1') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_works_without_what_those_operators_need(tmp_path):
    for name in ("zstandard", "tokenizers", "public_tokenizers"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.py").write_text("raise ModuleNotFoundError('hidden')")
        code = "import __spark_entry__ as e; q = e.queries(); assert 'lww_state' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        root = Path(__file__).resolve().parent.parent
        subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": f"{tmp_path / name}:{root}"})


def test_engine(spark, tmp_path):
    from tallyforge.engine import Engine

    for side in ("a", "b"):
        os.makedirs(tmp_path / side / "d")
        (tmp_path / side / "d" / "x").write_bytes(b"1" * 70_000)
        (tmp_path / side / "y").write_bytes(side.encode())
    e = Engine(spark)
    assert e.verify(str(tmp_path / "a"), str(tmp_path / "a")).first().outcome == "VERIFIED"
    assert e.verify(str(tmp_path / "a"), str(tmp_path / "b")).first().outcome == "PARTIAL"
    assert e.checkpoint(str(tmp_path / "a")).first().files == 2
    e.export(str(tmp_path / "a"), str(tmp_path / "archive"), "id", 1)
    assert {r.path: bytes(r.content) for r in e.restore(str(tmp_path / "archive")).collect()} == {"d/x": b"1" * 70_000, "y": b"a"}
    assert e.drill(str(tmp_path / "archive")).first().digest_ok


def test_segmented_log(spark, tmp_path):
    made = tables.generate_log(spark, 4000, 12)
    held = segments.SegmentedLog(spark, str(tmp_path / "s"), 250)
    assert held.scan().count() == 0 and held.check().count() == 0
    held.append(made.where("seq <= 3000"), 0)
    held.append(made.where("seq > 3000"), 1)
    held.append(made.where("seq > 3000"), 1)
    assert held.index().count() >= 12 and held.scan().count() == 4000
    for low, high in ((1, 4000), (990, 1010), (2999, 3002), (4000, None), (5000, 6000)):
        got = [r.seq for r in held.scan(low, high).select("seq").collect()]
        assert sorted(got) == list(range(low, min(4000, high or 4000) + 1))
    assert len(held.files(990, 1010)) <= 2 and len(held.files(2999, 3002)) <= 3 and len(held.files(5000, 6000)) == 0
    assert held.scan(990, 1010).inputFiles() == [] or len(held.scan(990, 1010).inputFiles()) <= 2
    assert held.check().where("not ok").count() == 0

    victim, other = held.files(1500, 1500)[0], held.files(3900, 3900)[0]
    path = Path(victim.removeprefix("file://").removeprefix("file:"))
    path.write_text(path.read_text().replace('"kind":"', '"kind":"x', 1))
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    Path(other.removeprefix("file://").removeprefix("file:")).unlink()
    assert held.scan(1, 100).count() == 100  # damage elsewhere is not met
    bad = {r.file: (r.missing, r.damaged) for r in held.check().where("not ok").collect()}
    assert bad == {victim: (False, 1), other: (True, 0)}
    with pytest.raises(Exception, match="damaged log line"):
        held.scan(1500, 1500).collect()


def test_writers_at_once(spark, tmp_path):
    row = lambda *keys, holder="x": spark.createDataFrame([(k, 1, 1, holder) for k in keys], schema.FENCE)
    held = lambda s: {r.resource: r.holder for r in s.load().collect()}
    one, two = (tables.Store(spark, str(tmp_path / "s"), schema.FENCE, "resource") for _ in range(2))
    one.put(row("a", "b"))
    base = two.head()
    one.put(row("c"))
    two.put(row("d"), base)  # other keys: takes the next number
    assert held(one) == {k: "x" for k in "abcd"} and two.head() == 3
    with pytest.raises(tables.Conflict):
        two.put(row("c", holder="late"), base)
    two.put(row("c", holder="late"))
    assert held(one)["c"] == "late" and {r.resource for r in one.load(1).collect()} == {"a", "b"}
    with pytest.raises(tables.Conflict):
        one.delete("c", 3)
    with concurrent.futures.ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: tables.Store(spark, str(tmp_path / "s"), schema.FENCE, "resource").put(row(f"t{k}")), range(16)))
    assert {f"t{k}" for k in range(16)} <= set(held(one)) and len(held(one)) == 20
    assert one.versions() == list(range(1, one.head() + 1))  # no number twice, none left out
    one.put(row("a", holder="last"))
    gone = one.expire()
    assert len(gone) >= 16 and len(held(two)) == 20 and held(two)["a"] == "last"
    with pytest.raises(KeyError):
        one.load(1)


def test_publish_names_a_file_once(spark, tmp_path):
    with concurrent.futures.ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: tables.publish(spark, str(tmp_path), "1", str(k)), range(24)))
    assert sum(got) == 1 and tables.read_small(spark, str(tmp_path / "1")) == str(got.index(True)) and [n for n in tables.children(spark, str(tmp_path)) if "aside" in n] == []


def test_op_ids_are_forgotten(spark, tmp_path):
    base = datetime(2024, 1, 1)
    batches = [[("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], [("a", 4, 5), ("c", 5, 120)], [("d", 6, 121)], [("a", 7, 180), ("c", 8, 181)]]  # (op, seq, minute)
    for k, rows in enumerate(batches):
        spark.createDataFrame([(op, seq, base + timedelta(minutes=m)) for op, seq, m in rows], "op string, seq long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = state.first_of_op(stream.read(spark, str(tmp_path / "in"), 1), "op", "seq", "ts", 3600)
        got = stream.run_to_table(found, "append", folder=str(tmp_path / "run"), rocksdb=True)  # stops after each batch
    assert sorted((r.seq, r.effective_seq, r.is_first) for r in got.collect()) == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 1, False), (5, 5, True), (6, 6, True), (7, 7, True), (8, 5, False)]


def test_running_state_outlives_a_stop(spark, tmp_path):
    base = datetime(2024, 1, 1)
    halves = [[("x", 1, 5.0), ("x", 3, 9.0), ("y", 1, 1.0), ("x", 2, 7.0)], [("x", 3, 50.0), ("x", 4, 2.0), ("y", 9, 8.0), ("x", 5, 8.0)]]
    for rows in halves:
        spark.createDataFrame([(k, base + timedelta(hours=h), v) for k, h, v in rows], "k string, at timestamp, backlog double").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        found = state.running(stream.read(spark, str(tmp_path / "in"), 64), ["k"], "at", {"big": F.col("backlog") > 6}, ("backlog",), history=2)
        got = stream.run_to_table(found, "append", folder=str(tmp_path / "run"), rocksdb=True)
    rows = sorted((r.k, r.at.hour, r.late, r.samples, r.big_so_far, r.previous_backlog) for r in got.collect() if not r.late)
    assert rows == [("x", 1, False, 1, 0, None), ("x", 2, False, 2, 1, 5.0), ("x", 3, False, 3, 2, 7.0), ("x", 4, False, 4, 2, 9.0), ("x", 5, False, 5, 3, 2.0), ("y", 1, False, 1, 0, None), ("y", 9, False, 2, 1, 1.0)]
    late = [r for r in got.collect() if r.late]
    assert [(r.k, r.backlog, r.samples) for r in late] == [("x", 50.0, None)]
    assert {(r.k, r.span_us) for r in got.where("not late").collect()} == {("x", 3_600_000_000), ("y", 0), ("y", 8 * 3_600_000_000)}
