"""Language, quality, media, sharding and the pipeline."""

import hashlib
import io
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import common, gif, language, quality, queries, sharding, simhash


def test_rank_order_by_hand():
    assert sorted(chr(g) for g in language.ngrams("Ab, a") if g < 1 << 21) == ["a", "a", "b"]
    assert len(language.ngrams("ab a")) == 3 + 5 + 3  # letters, pairs with blanks, and _ab ab_ _a_
    assert len(language.ngrams("12 ?!")) == 0 and len(language.ngrams("\u0301 \u0301")) == 0
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940"  # one word of three letters and three marks
    assert len(language.ngrams(hindi)) == 6 + 7 + 6 and len(language.ngrams(f"\u093f {hindi}")) == 6 + 7 + 6
    profiles = {"xx": language.top_ngrams("aa ab ab ba").tolist(), "yy": language.top_ngrams("zz zy yz").tolist()}
    c = language.Classifier(profiles)
    assert c("aab ba")[0] == "xx" and c("zyz zz")[0] == "yy" and c("aa ab ab ba") == ("xx", 1.0)
    assert c(None) == c("") == c("123") == ("und", 0.0)
    top = language.top_ngrams("aab ba").tolist()
    distance = sum(abs(i - profiles["xx"].index(g)) if g in profiles["xx"] else language.PROFILE for i, g in enumerate(top))
    assert c("aab ba")[1] == 1 - distance / (language.PROFILE * len(top))


def test_language_profiles_and_accuracy(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.99 * len(held) > 0
    train = [r for r in rows if not got[r.doc_id].held_out and r.lang]
    counts = {}
    for r in train:
        counts.setdefault(r.lang, Counter()).update(language.ngrams(r.text).tolist())
    want = {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]] for k, c in counts.items()}
    assert language.learn(docs.where(~language.held_out("doc_id"))) == want


def test_language_of_odd_rows(odd_docs, no_docs):
    got = language.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 17)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language.identify(no_docs).count() == 0
    assert {r.lang_pred for r in language.predict(odd_docs, {}).collect()} == {"und"}


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(4)
    m = len(quality.LABELLERS)
    good = rng.random(30_000) < 0.8
    accuracy = np.linspace(0.65, 0.95, m)
    right = rng.random((len(good), m)) < accuracy
    cast = rng.random((len(good), m)) < 0.7
    vote = np.where(cast, np.where(right == good[:, None], quality.GOOD, quality.BAD), quality.NONE)
    codes = (vote * 3 ** np.arange(m - 1, -1, -1)).sum(1)
    model = quality.fit_labels(Counter(codes.tolist()))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.03
    assert ((model.posterior(codes) >= 0.5) == good).mean() > 0.95


def test_quality_against_labels(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs)).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i].keep for i, q in labels.items() if q]) > 0.99
    assert np.mean([not got[i].keep for i, q in labels.items() if not q]) > 0.95


def test_quality_of_odd_rows(odd_docs, no_docs):
    model = quality.fit(odd_docs)
    got = quality.classify(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert quality.classify(no_docs, quality.fit(no_docs)).count() == 0


def test_clean_texts_of_any_script_pass(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    clean = [
        "Сегодня утром мы вышли из дома рано и долго шли по тихой улице к старому парку, где уже цвели липы.",
        "今天早上我们很早就出门了，沿着安静的街道走了很久，来到开满鲜花的老公园。",
        "今朝は早く家を出て、静かな通りを長い間歩いて古い公園に行きました。",
        "เช้านี้เราออกจากบ้านแต่เช้าและเดินไปตามถนนที่เงียบสงบเป็นเวลานาน",
        "Σήμερα το πρωί φύγαμε νωρίς από το σπίτι και περπατήσαμε για ώρα σε έναν ήσυχο δρόμο.",
        "هذا الصباح خرجنا من البيت مبكرا ومشينا طويلا في شارع هادئ حتى وصلنا إلى الحديقة القديمة",
    ]
    assert all(quality.LABELLERS["prose"](quality.Page.of(t.encode())) == quality.GOOD for t in clean)
    bad = ["!!! $$$ ### @@@ BUY NOW!!! $$$", "a a a a a a a a a a a a a a a a a a a a a a"]
    assert not any(quality.LABELLERS["prose"](quality.Page.of(t.encode())) == quality.GOOD for t in bad)
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(clean + bad)], docs.schema)
    got = {r.doc_id: r for r in quality.classify(more, quality.fit(docs)).collect()}
    assert all(got[10**7 + i].posterior > 0.5 for i in range(len(clean)))
    assert [got[10**7 + i].keep for i in range(len(clean))] == [True] * len(clean)


def test_identical_rows_and_order(spark):
    same = spark.createDataFrame([(1, "The cat sat on the mat and looked out of the window.")] * 3000, "doc_id long, text string")
    scores = {(r.score, r.keep) for r in quality.classify(same, quality.fit(same)).collect()}
    assert len(scores) == 1 and all(0.5 < s and keep for s, keep in scores)
    docs = common.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    one, two = quality.fit(docs.repartition(2)), quality.fit(docs.unionByName(docs).orderBy(F.desc("doc_id")).dropDuplicates(["doc_id"]).repartition(5))
    assert np.array_equal(one.scorer.weights, two.scorer.weights) and one.scorer.bias == two.scorer.bias


def make_gif(width, height, images, palette, interlace=False, code_size=8):
    """images: (left, top, rows, disposal, transparent, delay, local palette)."""
    import struct

    bits = max(1, (len(palette) - 1).bit_length()) - 1
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | bits, 0, 0), bytes(itertools.chain(*palette))]
    for left, top, rows, disposal, transparent, delay, local in images:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0")
        flags = 0x40 * interlace | (0x80 | max(1, (len(local) - 1).bit_length()) - 1 if local else 0)
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), flags) + bytes(itertools.chain(*(local or []))))
        order = [y for a, s in gif.INTERLACE for y in range(a, len(rows), s)] if interlace else range(len(rows))
        codes = gif.lzw_encode(bytes(itertools.chain(*(rows[y] for y in order))))
        out.append(b"\x08" + b"".join(bytes([len(x := codes[i : i + 200])]) + x for i in range(0, len(codes), 200)) + b"\0")
    return b"".join(out) + b"\x3b"


def test_lzw_round_trips():
    rng = random.Random(2)
    for data in (b"", b"a", b"aaaa" * 3000, bytes(range(256)) * 40, rng.randbytes(30_000), ("the cat sat on the mat. " * 4000).encode(), *(rng.randbytes(n) for n in range(250, 262))):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    whole = gif.lzw_encode(b"hello hello hello hello")
    for cut in range(len(whole) - 2):
        with pytest.raises(ValueError):
            gif.lzw_decode(whole[:cut], 8, 23)


def test_lzw_by_hand():
    # The ten by ten sample image of the public format description: 4 colours, code size 2.
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    pixels = gif.lzw_decode(stream, 2, 100)
    assert pixels[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and pixels[30:40] == bytes([1, 1, 1, 0, 0, 0, 0, 2, 2, 2])


@pytest.mark.parametrize("interlace", [False, True])
def test_palettes_disposal_and_transparency(interlace):
    red, green, blue, white = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    full = [[0] * 4 for _ in range(6)]
    data = make_gif(4, 6, [
        (0, 0, full, 1, None, 10, None),
        (1, 1, [[1, 2], [2, 1]], 3, 2, 5, None),
        (0, 0, [[0]], 2, None, 7, [white, blue]),
        (3, 5, [[3]], 0, None, 1, None),
    ], [red, green, blue, white], interlace)
    shown = [(i.delay_ms, c.copy()) for i, c in gif.compose(gif.parse(data))]
    assert [d for d, _ in shown] == [100, 50, 70, 10]
    assert (shown[0][1] == [255, 0, 0, 255]).all()
    assert shown[1][1][1, 1].tolist() == [0, 255, 0, 255] and shown[1][1][1, 2].tolist() == [255, 0, 0, 255]
    assert shown[2][1][1, 1].tolist() == [255, 0, 0, 255] and shown[2][1][0, 0].tolist() == [255, 255, 255, 255]
    assert shown[3][1][0, 0].tolist() == [0, 0, 0, 0] and shown[3][1][5, 3].tolist() == [255, 255, 255, 255]
    h = gif.histogram(shown[3][1])
    assert h[15] == 23 and h[gif.BINS] == 22 and h[: gif.BINS].sum() == 23  # one pixel is transparent


def test_frames_table(spark):
    data = gif.encode_samples(b"ab" * 96 * 600)
    df = spark.createDataFrame([(1, data, "x"), (2, None, "y"), (3, data[:900], "z"), (4, b"", "w")], "id long, media binary, frame string")
    rows = gif.timed_frames(df, "id", "media").collect()
    assert [(r.frame, r.start_ms, r.delay_ms, r.height, r.canvas_height) for r in sorted((r for r in rows if r.media_id == 1), key=lambda r: r.frame)] == [(0, 0, 40, 256, 256), (1, 40, 40, 256, 256), (2, 80, 40, 88, 256)]
    assert {r.media_id for r in rows if r.error} == {3, 4} and not [r for r in rows if r.media_id == 2]
    assert all(sum(r.hist_r) == r.canvas_width * r.canvas_height for r in rows if not r.error)


@pytest.mark.parametrize("docs", ["odd_docs", "some_docs", "no_docs"])
def test_text_media(request, docs):
    df = request.getfixturevalue(docs)
    stored = common.materialise(gif.store_texts(df), "media")
    media = Counter((r.doc_id, hashlib.sha256(r.media).hexdigest()) for r in stored.collect())
    decoded = common.materialise(gif.decode_stored(stored), "frames")
    got = gif.features(decoded).collect()
    want = Counter()
    for r in df.collect():
        t = (r.text or "").encode()
        p = t + b" " * (max(192, -(-len(t) // 192) * 192) - len(t))
        want[r.doc_id, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert Counter((r.doc_id, r.media_sha256) for r in got) == media
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    for r in decoded.collect():
        assert sum(f.width * f.height for f in r.frames) == r.payload_bytes
        assert {tuple(map(sum, (f.hist_r, f.hist_g, f.hist_b))) for f in r.frames} == {(192 * r.frames[0].height,) * 3}  # all of the canvas is visible
        assert [f.start_ms for f in r.frames] == [40 * k for k in range(len(r.frames))]


def test_large_texts_take_many_frames(spark):
    text = "".join(chr(32 + i % 90) for i in range(3 * 192 * 256 + 5))
    stored = gif.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    r = gif.features(gif.decode_stored(stored)).first()
    payload = text.encode().ljust(-(-len(text) // 192) * 192)
    assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    shown, canvas = np.zeros(16, np.int64), np.zeros((256, 192), np.uint8)
    for at in range(0, len(payload), canvas.size):
        part = np.frombuffer(payload[at : at + canvas.size], np.uint8).reshape(-1, 192)
        canvas[: len(part)] = part  # what lies below a shorter last image stays
        shown += np.bincount(canvas.ravel() // 16, minlength=16)
    reds = ".".join(map(str, shown))
    assert r.feature == f"frames=4;ms=160;r={reds};g={reds};b={reds}"


def test_hostile_headers_and_damage_in_mid_file(spark):
    good = gif.encode_samples(b"xy" * 96 * 600)  # three frames
    hostile = bytearray(gif.encode_samples(b"a" * 192))
    hostile[6:10] = b"\xff\xff\xff\xff"  # the screen claims 65,535 x 65,535 pixels
    images = [i for i in range(len(good) - 9) if good[i] == 0x2C and good[i + 1 : i + 7] == b"\0\0\0\0\xc0\0"]
    broken = bytearray(good)
    broken[images[1] + 13 : images[1] + 40] = b"\xff" * 27  # codes beyond the table in the second image
    rows = gif.timed_frames(spark.createDataFrame([(1, bytes(hostile)), (2, bytes(broken)), (3, good)], "id long, media binary"), "id", "media").collect()
    assert [(r.frame, "pixels" in r.error) for r in rows if r.media_id == 1] == [(None, True)]
    assert [(r.frame, r.error is None) for r in rows if r.media_id == 2] == [(0, True), (None, False)]
    assert [r.frame for r in rows if r.media_id == 3] == [0, 1, 2]


@pytest.mark.parametrize("docs", ["odd_docs", "some_docs", "no_docs"])
def test_shards(request, docs):
    df = request.getfixturevalue(docs)
    got = sharding.assign(df, 4).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    if docs == "some_docs":
        groups = {}
        for r in got:
            assert groups.setdefault(r.text_crc32, r.shard) == r.shard
        filled = [sum(r.size for r in got if r.shard == s) for s in range(4)]
        assert max(filled) - min(filled) <= 0.02 * sum(filled) / 4


def filled_shards(got, shards=16):
    return np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=shards)


@pytest.mark.parametrize("rows, apart", [
    ([(i, "same text" if i % 3 == 0 else f"text number {i:05d}") for i in range(3000)], 25),
    ([(i % 8, "x" * 50_000) for i in range(8)] + [(100 + i, f"{i:04d}" + "y" * 996) for i in range(800)], 1002),
    ([(7, "repeated " * 555)] * 400 + [(i, f"small {i}") for i in range(2000)], 5002),
    ([(None, "no id at all")] * 500 + [(i, f"text {i}") for i in range(300)], 20),
    ([(k * 100 + i, f"group {k:02d} of seventeen") for k in range(17) for i in range(40)], 30),
    ([(1, "one row only")], 13),
])
def test_bytes_come_out_nearly_equal(spark, rows, apart):
    """Within two hundredths of the mean, or a row's size where that is more; slots are gapless and equal texts together unless a group was cut."""
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 16).collect()
    filled = filled_shards(got)
    assert filled.max() - filled.min() <= max(0.02 * filled.mean(), apart)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    sizes = Counter(r.text_crc32 for r in got)
    assert all(len(h) == 1 for t, h in homes.items() if sizes[t] == 1)


def test_evening_ends_only_when_no_move_helps():
    """Six thousand moves and more, from one full shard."""
    out = sharding.level(np.ones(8000), np.zeros(8000, np.int64), 16)
    assert set(np.bincount(out, minlength=16)) == {500}


def test_known_grams_of_the_sample(spark):
    """The bits that tasks give are those of all texts of the sample, long ones too."""
    texts = ["", "short", "Ünïcode text 東京", "word " * 20_000, *[f"text number {k}" for k in range(50)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = np.zeros(1 << quality.KNOWN, bool)
    for t in texts:
        want[quality.mixed(quality.trigrams(t.encode()), quality.KNOWN)] = True
    assert quality.fit(docs).known == np.packbits(want).tobytes() and want.any()


def test_tokens_of_groups(spark):
    texts = ["", None, " ", " lead", "tail ", "a  b\tc\n", "\u00a0x", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    text = common.text_of("text")
    n = [r[0] for r in df.orderBy("doc_id").select(F.size(F.array_remove(F.split(text, r"\s+"), ""))).collect()]
    assert n == [0, 0, 0, 1, 1, 3, 1, 1]


def test_placing_follows_residual_capacity():
    loads = np.array([[8, 0, 0], [0, 8, 0], [0, 0, 8], [8, 0, 0], [0, 8, 0], [0, 0, 8]], dtype=float)
    out = sharding.place(loads, 2, (1.0, 1.0, 1.0))
    for k in range(3):
        assert {out[k], out[k + 3]} == {0, 1}


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = common.documents(spark, sf_dir)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), name)
        if k < 3:
            assert docs.columns == columns
            assert not docs.exceptAll(before).count()
    whole = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in docs.collect()} == whole
    start = common.documents(spark, sf_dir)
    quality_kept = quality.classify(start, quality.fit(start)).where("keep").count()
    assert len(whole) <= quality_kept
    ids = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
    assert all(i == c for i, c in ids.items())


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialise(stage(spark, docs, ""), name)
        assert docs.count() >= 0


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert io and corpus_pipeline.ORACLE_SQL is None


def test_damaged_stored_media_give_an_error_row(spark):
    good = gif.encode_samples(b"a" * 192)
    df = spark.createDataFrame([(1, 5, good), (2, 5, None), (3, 5, good[:400]), (4, 5, b"no gif")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in gif.decode_stored(df).collect()}
    assert got[1].error is None and got[1].payload_bytes == 192
    assert all(got[k].error and got[k].payload_sha256 is None and got[k].frames is None for k in (2, 3, 4)) and got[2].media_bytes is None and got[3].media_bytes == 400
    assert gif.features(gif.decode_stored(df)).count() == 4
