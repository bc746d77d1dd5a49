"""Token output, counts, packing and BPE against the tokenizers library on whole texts."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import bpe, common, packing, queries, token_counts, token_files


def library(path):
    return Tokenizer.from_file(path)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def both(*names):
    return pytest.mark.parametrize("docs", names)


def rows(request, docs):
    df = request.getfixturevalue(docs)
    return df, [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@both("odd_docs", "some_docs", "no_docs")
def test_token_files(request, spark, docs):
    df, texts = rows(request, docs)
    manifest = token_files.write_tokens(df, common.shared_dir(spark, "t"), queries.WORD_BPE, end_id=2, frame_tokens=500)
    got = token_files.token_positions(manifest).collect()
    k = library(queries.WORD_BPE)
    want = [(i, [*k.encode(t, add_special_tokens=False).ids, 2]) for i, t in texts]
    assert sorted(((r.doc_id is not None, r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(((i is not None, i), len(x), crc(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_random_access_reads_few_frames_and_sees_damage():
    sink = io.BytesIO()
    writer = token_files.Writer(sink, frame_tokens=50)
    docs = {i: np.arange(i, i * 2, dtype="<u4") * (70_000 if i % 7 == 0 else 1) for i in range(200)}
    for i, ids in docs.items():
        writer.add(i, ids.tobytes())
    writer.close()
    reader = token_files.Reader(Source(sink.getvalue()))
    before = reader.unpacked_frames
    got = {d.doc_id: d.ids.tolist() for d in reader.get([3, 150, 999])}
    assert got == {3: docs[3].tolist(), 150: docs[150].tolist()}
    assert reader.unpacked_frames - before == 2 < len(reader.frames)
    assert {d.doc_id: d.ids.tolist() for d in reader} == {i: x.tolist() for i, x in docs.items()}
    broken = bytearray(sink.getvalue())
    broken[reader.frames[2].at + reader.frames[2].packed - 3] ^= 255
    with pytest.raises(Exception):
        list(token_files.Reader(Source(bytes(broken))))


def test_one_document_unpacks_one_small_frame(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    manifest = token_files.write_tokens(docs, common.shared_dir(spark, "t"), queries.WORD_BPE, end_id=2)
    k = library(queries.WORD_BPE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {}
    for m in manifest.collect():
        reader = token_files.open_reader(m.path)
        first = [next(reader._documents(x)).doc_id for x in range(len(reader.index))]
        assert len(reader.index) >= m.n_tokens // (2 * token_files.FRAME_TOKENS)
        for i in random.Random(m.part).sample(first, min(5, len(first))):
            before = reader.unpacked_frames
            (d,) = reader.get([i])
            assert reader.unpacked_frames == before + 1
            found[i] = d.ids.tolist()
        sizes = [sum(len(d.ids) for d in reader._documents(x)) for x in range(len(reader.index))]
        alone = [sum(1 for _ in reader._documents(x)) == 1 for x in range(len(reader.index))]
        assert all(n <= token_files.FRAME_TOKENS or one for n, one in zip(sizes, alone, strict=True))
    assert found and all(x == [*k.encode(texts[i], add_special_tokens=False).ids, 2] for i, x in found.items())


def test_equal_ids_spread_over_files(spark):
    rows = [(5, f"text {i % 700}") for i in range(4000)] + [(None, "no id")] * 2000 + [(9, "one row many times")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    old, token_files.LEAST_BYTES = token_files.LEAST_BYTES, 1 << 13
    try:
        manifest = token_files.write_tokens(df, common.shared_dir(spark, "t"), queries.WORD_BPE, end_id=2)
    finally:
        token_files.LEAST_BYTES = old
    files = manifest.collect()
    assert len(files) == 8 and max(m.n_docs for m in files) < 2 * len(rows) / len(files)
    got = token_files.token_positions(manifest).collect()
    k = library(queries.WORD_BPE)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x := [*k.encode(t, add_special_tokens=False).ids, 2]), crc(x)) for i, t in rows)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_files_follow_the_input():
    assert token_files.files_for(0, 200) == 1 and token_files.files_for(3 << 20, 200) == 3
    assert token_files.files_for(1 << 30, 200) == 200 and token_files.files_for(100 << 40, 200) == 819_200


@both("odd_docs", "some_docs", "no_docs")
def test_counts(request, docs):
    df, texts = rows(request, docs)
    k = library(queries.BYTE_BPE)
    want = Counter((i, len(t.encode()), n := len(k.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts)
    assert Counter(map(tuple, token_counts.count_tokens(df, queries.BYTE_BPE).collect())) == want


def test_cache_encodes_only_misses(spark, some_docs):
    cache = token_counts.DigestCache(spark)
    first = token_counts.count_tokens(some_docs.where("doc_id % 2 = 0"), queries.BYTE_BPE, cache)
    n = first.count()
    version = token_counts.tokenizer_version(queries.BYTE_BPE)
    stored = spark.read.parquet(cache.uri).count()
    assert stored == cache.read(version).count() <= n
    token_counts.count_tokens(some_docs, queries.BYTE_BPE, cache).count()
    assert spark.read.parquet(cache.uri).count() == cache.read(version).count() == some_docs.select("text").distinct().count()


def test_repeated_rows_are_encoded_once(spark, tmp_path):
    """The cache has one row an encoding."""
    rows = [(7, "the same row")] * 200 + [(None, "no id here")] * 300 + [(i, "the same row") for i in range(50)] + [(1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    cache = token_counts.DigestCache(spark, str(tmp_path / "cache"))
    assert token_counts.count_tokens(df, queries.BYTE_BPE, cache).count() == len(rows)
    assert spark.read.parquet(cache.uri).count() == 3
    more = df.unionByName(spark.createDataFrame([(9, "a new text")], df.schema))
    assert token_counts.count_tokens(more, queries.BYTE_BPE, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache.uri).count() == 4


def test_the_query_joins_what_an_earlier_run_stored(spark, sf_dir, tmp_path):
    spark.conf.set(queries.TOKEN_CACHE, str(tmp_path / "kept"))
    try:
        first = Counter(map(tuple, queries.op5_token_counts(spark, sf_dir).collect()))
        stored = spark.read.parquet(str(tmp_path / "kept")).count()
        assert stored == spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").distinct().count()
        assert Counter(map(tuple, queries.op5_token_counts(spark, sf_dir).collect())) == first
        assert spark.read.parquet(str(tmp_path / "kept")).count() == stored  # every count was a hit
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)


def test_sentencepiece_counts(spark, odd_docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    k = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd_docs, path).collect())
    assert got == Counter((r.doc_id, len(k.encode(r.text or ""))) for r in odd_docs.collect())


@both("odd_docs", "some_docs", "no_docs")
def test_packing(request, docs):
    df, texts = rows(request, docs)
    k = library(queries.WORD_BPE)
    got = packing.pack_documents(df, queries.WORD_BPE, capacity=256).collect()
    want = Counter()
    for i, t in texts:
        ids = [*k.encode(t, add_special_tokens=False).ids, 0]
        want.update((i, p, p * 256, len(x := ids[p * 256 : p * 256 + 256]), crc(x)) for p in range(-(-len(ids) // 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_of_rows_that_repeat(spark):
    df = spark.createDataFrame([(7, "one row many times")] * 3000 + [(None, "no id")] * 500, "doc_id long, text string").repartition(5)
    got = packing.pack_documents(df, queries.WORD_BPE, capacity=64).collect()
    assert len(got) == 3500
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_is_best_fit_decreasing():
    def plain(lengths, capacity):
        room = []
        for x in sorted(lengths, reverse=True):
            fit = min((r for r in room if r >= x), default=None)
            if fit is None:
                room.append(capacity - x)
            else:
                room[room.index(fit)] -= x
        return len(room), Counter(room)

    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 64, 100])
        lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.randrange(400))]
        segments, used = packing.plan(Counter(lengths), capacity)
        filled = Counter()
        for s in segments:
            for j in range(s.n):
                filled[s.sequence + j // s.each] += s.length
        assert (used, Counter(capacity - x for x in filled.values())) == plain(lengths, capacity)


@both("odd_docs", "some_docs", "no_docs")
def test_bpe(request, docs):
    df, texts = rows(request, docs)
    k = library(queries.WORD_BPE)
    want = Counter()
    for i, t in texts:
        ids = k.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(k.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digest_documents(df, queries.WORD_BPE).collect())) == want
    full = bpe.encode_documents(df, queries.WORD_BPE).select("doc_id", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), F.sha2("decoded", 256))
    assert Counter(map(tuple, full.collect())) == want


def test_bpe_every_code_point():
    k, own = library(queries.WORD_BPE), bpe.load(queries.WORD_BPE)
    points = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F700)]
    wrong = [c for c in points if own.encode(f"a{c}b {c}") != k.encode(f"a{c}b {c}", add_special_tokens=False).ids]
    assert not wrong, [hex(ord(c)) for c in wrong]


def test_word_pieces_give_whole_text_ids():
    k = library(queries.WORD_BPE)
    rng = random.Random(7)
    letters = "ab'sΣé́ \t\n  \x1c.,!1½日<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    memo = common.word_ids(queries.WORD_BPE)
    for t, got in zip(texts, memo(pa.array(texts)), strict=True):
        assert got.tolist() == k.encode(t, add_special_tokens=False).ids, repr(t)
    sliced = pa.array([*texts, None, "The END"])
    assert [x.tolist() for at in range(0, len(sliced), 700) for x in memo(sliced.slice(at, 700))] == [k.encode(t or "", add_special_tokens=False).ids for t in sliced.to_pylist()]
    own = bpe.load(queries.WORD_BPE)
    for t in texts:
        assert own.encode(t) == k.encode(t, add_special_tokens=False).ids, repr(t)
    b, count = library(queries.BYTE_BPE), token_counts.counter(queries.BYTE_BPE)
    assert count(texts) == [len(b.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_words_use_the_heap_alike():
    own = bpe.load(queries.WORD_BPE)
    rng = random.Random(3)
    for n in (2, 50, 97, 300, 1000):
        parts = [own.inner[rng.choice(b"theraning")] for _ in range(n)]
        heap = own._merge_long(parts[:])
        bpe.SHORT, was = 10**9, bpe.SHORT
        try:
            assert own.merge(parts[:]) == heap
        finally:
            bpe.SHORT = was
