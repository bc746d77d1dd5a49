"""The training-data operators as queries over the test tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, gif, language, packing, pivots, quality, resampling, runs, sharding, simhash, token_counts, token_files, vantage

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return quality.classify(docs, quality.fit(docs))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(common.documents(spark, sf_dir), common.shared_dir(spark, "tokens"), WORD_BPE, end_id=2)
    return token_files.token_positions(manifest)


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the texts as GIF files, decodes the files into a stored table of timed frames, and reads the results from that table."""
    media = common.materialise(gif.store_texts(common.documents(spark, sf_dir)), "gif-media")
    frames = common.materialise(gif.decode_stored(media), "gif-frames")
    common.discard(media)
    return gif.features(frames)


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Session setting: the folder of a digest cache that outlives the run.  Unset: a cache of this run's own.
TOKEN_CACHE = "spark.tallyforge.tokenCache"


def op5_token_counts(spark: SparkSession, sf_dir: str, cache_uri: str | None = None) -> DataFrame:
    """With ``cache_uri`` (or ``TOKEN_CACHE``) counts that earlier runs stored are joined, and only new texts are encoded."""
    cache = token_counts.DigestCache(spark, cache_uri or spark.conf.get(TOKEN_CACHE, None))
    return token_counts.count_tokens(common.documents(spark, sf_dir), BYTE_BPE, cache)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign(common.documents(spark, sf_dir))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir), WORD_BPE)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(common.documents(spark, sf_dir), WORD_BPE)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its id becomes periodic from a word of its own on; a null id leaves the text as it is."""

    def plant(batches):
        for b in common.rows_of(batches):
            texts = common.texts_as_bytes(b.column(1))
            for k, doc_id in enumerate(b.column(0).to_pylist()):
                h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
                words = texts[k].split() if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of("text").alias("text")).mapInArrow(plant, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(_planted(common.documents(spark, sf_dir))))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus drawn towards the benchmark texts."""
    return resampling.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_files, op3_gif, op4_pivot_index, op5_token_counts,
        op6_sharding, op7_best_fit_packing, op8_bpe, op9_language_id, op10_simhash,
        op11_periodic_runs, op12_importance_resampling, op13_vantage_trees,
    )
}

#: DuckDB SQL of those queries that SQL can express: all pairs within a label, n-gram profiles by rank, weights by hashed features, and all inner products (op13 is
#: approximate: it finds them all on sf0.001 and sf0.01, elsewhere a few may be missing).
ORACLE_SQL: dict[str, str] = {
    "op4_pivot_index": """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
walk(vec_id, reach) AS (SELECT vec_id, vec_id FROM e UNION SELECT walk.vec_id, link.b FROM walk JOIN link ON walk.reach = link.a)
SELECT w.vec_id, coalesce(n, 0) AS n_links, component_id, w.vec_id = component_id AS kept
FROM (SELECT vec_id, min(reach) AS component_id FROM walk GROUP BY vec_id) w LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON w.vec_id = l.a""",
    "op9_language_id": r"""WITH d AS (SELECT doc_id, lang, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT) AS id_bytes,
  coalesce('_' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}]+'), lambda w: w <> ''), '_') || '_', '__') AS s FROM documents),
c AS (SELECT doc_id, lang, s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, id_bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 3 = 1 AS held_out FROM d),
o AS (SELECT doc_id, lang, held_out, string_split(s, '') AS ch FROM c WHERE s <> '__'),
p AS (SELECT doc_id, lang, held_out, unnest(ch) AS one, unnest(ch[2:]) AS two, unnest(ch[3:]) AS three FROM o),
q AS (SELECT *, CASE one WHEN '_' THEN 1 ELSE unicode(one) END::BIGINT AS x, CASE two WHEN '_' THEN 1 ELSE unicode(two) END::BIGINT AS y, CASE three WHEN '_' THEN 1 ELSE unicode(three) END::BIGINT AS z FROM p),
g AS (SELECT doc_id, lang, held_out, x AS gram FROM q WHERE one <> '_' UNION ALL SELECT doc_id, lang, held_out, x * 2097152 + y FROM q WHERE two IS NOT NULL
  UNION ALL SELECT doc_id, lang, held_out, (x * 2097152 + y) * 2097152 + z FROM q WHERE two <> '_' AND three IS NOT NULL),
profile AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place FROM (SELECT lang, gram, count(*) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY place < 300),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS place FROM (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL) QUALIFY place < 300),
size AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
near AS (SELECT own.doc_id, lang, sum(300 - abs(own.place - profile.place)) AS saved FROM own JOIN profile ON own.gram = profile.gram GROUP BY ALL),
every AS (SELECT size.doc_id, l.lang, CAST(300 * n - coalesce(saved, 0) AS BIGINT) AS distance, n FROM size CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN near ON near.doc_id = size.doc_id AND near.lang = l.lang),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT c.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - distance::DOUBLE / (300 * n)::DOUBLE, 0.0::DOUBLE) AS score FROM c LEFT JOIN best ON best.doc_id = c.doc_id""",
    "op12_importance_resampling": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
y AS (SELECT f, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM h),
c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) % 10000 AS bucket FROM y, steps),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN c USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM fb JOIN c USING (f) GROUP BY bucket),
z AS (SELECT (SELECT count(*) FROM fd) AS sz, (SELECT count(*) FROM fb) AS tz),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sz + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tz + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, z),
m AS (SELECT k, CAST(sum(gain) AS BIGINT) AS gains, count(*) AS n FROM fd JOIN c USING (f) JOIN g USING (bucket) GROUP BY k),
w AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(CAST((gains - ((gains % n) + n) % n) // n AS BIGINT), 0) AS weight FROM d LEFT JOIN m ON d.k = m.k),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || CAST(doc_id AS VARCHAR)), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY words < 20, score DESC, doc_id) AS place, 25 * count(*) FILTER (words >= 20) OVER () // 100 AS drawn FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM o""",
    "op13_vantage_trees": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), lambda a, b: a + b) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20""",
}
