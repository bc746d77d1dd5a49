"""The library's operators as queries over the test tables, each with the SQL it must equal.

Stand-ins: ``events`` is a change log (user_id the path, event_type the kind with
"error" as delete, value the size), ``documents`` are objects, ``orders`` a
catalog, ``conversations`` a phase history, ``customer`` deployments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import digests, rules, text
from ..operators import catalog, dedup, hash_tree, log_ops, series
from ..operators import manifest as mf
from ..sources import chunk_store, log, objects, ranges, segments, tables
from ..streaming import state, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Block size that gives most test documents several blocks.
SMALL_BLOCK = 1024


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.as_objects(tables.table(spark, sf_dir, "documents"))


def _edited(objs: DataFrame) -> DataFrame:
    """A candidate: every tenth object is gone, every seventh differs, and objects of its own stand beside."""
    k = F.col("path").cast("long")
    kept = objs.where(k % 10 != 0).withColumn("content", F.when(k % 7 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return kept.unionByName(objs.where(k % 50 == 0).withColumn("path", F.concat(F.lit("x"), "path")))


_OBJECTS = "objects AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, doc_id AS k, coalesce(text, '') AS text FROM documents)"
_BOTH = f"""WITH {_OBJECTS},
a AS (SELECT path, sha256(text) AS hash, octet_length(encode(text)) AS size FROM objects),
edited AS (
  SELECT path, CASE WHEN k % 7 = 0 THEN text || '!' ELSE text END AS text FROM objects WHERE k % 10 <> 0
  UNION ALL SELECT 'x' || path, text FROM objects WHERE k % 50 = 0),
c AS (SELECT path, sha256(text) AS hash, octet_length(encode(text)) AS size FROM edited),
d AS (SELECT coalesce(a.path, c.path) AS path, a.hash AS active_hash, c.hash AS candidate_hash,
  CASE WHEN c.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' WHEN a.hash <> c.hash THEN 'mismatch' ELSE 'same' END AS status
  FROM a FULL JOIN c ON a.path = c.path)
"""


@query("""SELECT * FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
arg_max(value, event_id) AS value FROM events GROUP BY user_id) WHERE event_type <> 'error'""")
def lww_state(spark, sf_dir):
    return log_ops.latest(tables.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "error", ["value"])


@query("""WITH e AS (SELECT *, event_id // 500 AS seq FROM events), n AS (SELECT user_id, max(seq) AS seq FROM e GROUP BY user_id)
SELECT user_id, seq, event_type, value FROM (SELECT user_id, seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM e JOIN n USING (user_id, seq) GROUP BY user_id, seq) WHERE event_type <> 'error'""")
def lww_repeated_seq(spark, sf_dir):
    """500 records share each seq, so a key's newest seq has several; the last in the log counts, be it a write or a delete."""
    e = tables.table(spark, sf_dir, "events").withColumn("seq", F.expr("event_id div 500"))
    return log_ops.latest(e, "user_id", "seq", "event_type", "error", ["value"], tie="event_id")


@query(f"{_BOTH} SELECT path, status, active_hash, candidate_hash FROM d")
def manifest_diff(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return mf.diff(mf.manifest(objs), mf.manifest(_edited(objs)))


_VERIFY = _BOTH.replace("%", "%%") + """, n AS (SELECT (SELECT count(*) FROM a) AS active_files, (SELECT CAST(sum(size) AS BIGINT) FROM a) AS active_bytes,
  (SELECT count(*) FROM c) AS candidate_files, (SELECT CAST(sum(size) AS BIGINT) FROM c) AS candidate_bytes,
  %s)
SELECT *, %s AS outcome FROM n"""
_BY = ", ".join(f"(SELECT count(*) FROM d WHERE status = '{s}') AS {s}" for s in ("missing", "extra", "mismatch"))


@query(_VERIFY % (_BY, "CASE WHEN mismatch + missing + extra = 0 THEN 'VERIFIED' WHEN mismatch + missing > 0 AND mismatch < active_files THEN 'PARTIAL' ELSE 'FAILED' END"))
def verify_outcome(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return mf.verify(mf.manifest(objs), mf.manifest(_edited(objs)))


@query(_VERIFY % ("0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS mismatch", "CASE WHEN active_files = candidate_files AND active_bytes = candidate_bytes THEN 'PARTIAL' ELSE 'FAILED' END"))
def verify_metadata(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    sized = lambda o: o.select("path", F.octet_length("content").cast("long").alias("size"))
    return mf.verify(sized(objs), sized(_edited(objs)), "METADATA")


@query(f"WITH {_OBJECTS} SELECT sha256(coalesce(string_agg(path || ':' || sha256(text) || chr(10), '' ORDER BY path), '')) AS root FROM objects")
def root_digest(spark, sf_dir):
    return digests.root_digest(mf.manifest(_docs(spark, sf_dir)))


@query(f"""WITH {_OBJECTS}, x AS (SELECT sha256(string_agg(path || chr(0) || sha256(text) || chr(0), '' ORDER BY path)) AS digest FROM objects)
SELECT digest, sha256(digest) AS root FROM x""")
def flat_digest(spark, sf_dir):
    return digests.flat_digest(mf.manifest(_docs(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_OBJECTS}, l AS (SELECT 0 AS level, list(sha256(path || ':' || sha256(text)) ORDER BY path) AS h FROM objects
UNION ALL SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i < len(h) THEN sha256(unhex(h[i]) || unhex(h[i + 1])) ELSE h[i] END) FROM l WHERE len(h) > 1)
SELECT h[1] AS root FROM l WHERE len(h) = 1""")
def merkle_root(spark, sf_dir):
    return spark.createDataFrame([(digests.merkle_root(mf.manifest(_docs(spark, sf_dir))),)], "root string")


@query(f"WITH {_OBJECTS}, p AS (SELECT substr(path, 1, 10) AS part, path, sha256(text) AS hash FROM objects) SELECT part, sha256(string_agg(path || ':' || hash || chr(10), '' ORDER BY path)) AS root FROM p GROUP BY part")
def root_digest_by_part(spark, sf_dir):
    return digests.root_digest(mf.manifest(_docs(spark, sf_dir)).withColumn("part", F.left("path", F.lit(10))), by=["part"])


_BLOCKS = f"""blocks AS (SELECT path, k, b * {SMALL_BLOCK} AS "offset", array_slice(encode(text), b * {SMALL_BLOCK} + 1, (b + 1) * {SMALL_BLOCK}) AS data
  FROM (SELECT path, k, text, unnest(range(CAST(ceil(octet_length(encode(text)) / {SMALL_BLOCK}.0) AS BIGINT))) AS b FROM objects))"""


@query(f'WITH {_OBJECTS}, {_BLOCKS} SELECT path, "offset", CAST(octet_length(data) AS INTEGER) AS length, sha256(data) AS hash FROM blocks')
def block_index(spark, sf_dir):
    return objects.blocks(_docs(spark, sf_dir), SMALL_BLOCK)


_TWO_BLOCKS = f"""WITH {_OBJECTS}, {_BLOCKS}, s AS (SELECT path, "offset", octet_length(data) AS length, sha256(data) AS hash FROM blocks),
edited AS (SELECT path, CASE WHEN k % 7 = 0 THEN text || '!' ELSE text END AS text FROM objects WHERE k % 10 <> 0
  UNION ALL SELECT 'x' || path, text FROM objects WHERE k % 50 = 0),
tb AS (SELECT path, b * {SMALL_BLOCK} AS "offset", array_slice(encode(text), b * {SMALL_BLOCK} + 1, (b + 1) * {SMALL_BLOCK}) AS data
  FROM (SELECT path, text, unnest(range(CAST(ceil(octet_length(encode(text)) / {SMALL_BLOCK}.0) AS BIGINT))) AS b FROM edited)),
t AS (SELECT path, "offset", octet_length(data) AS length, sha256(data) AS hash FROM tb)
"""


@query(f'{_TWO_BLOCKS} SELECT s.path, s."offset", CAST(s.length AS INTEGER) AS length, s.hash FROM s LEFT JOIN t ON s.path = t.path AND s."offset" = t."offset" WHERE t.hash IS NULL OR t.hash <> s.hash')
def block_diff(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return dedup.changed_blocks(objects.blocks(objs, SMALL_BLOCK), objects.blocks(_edited(objs), SMALL_BLOCK))


@query(f'{_TWO_BLOCKS} SELECT path, "offset", CAST(length AS INTEGER) AS length, hash FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = t.path AND s."offset" = t."offset")')
def block_extra(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return dedup.extra_blocks(objects.blocks(objs, SMALL_BLOCK), objects.blocks(_edited(objs), SMALL_BLOCK))


@query(f'{_TWO_BLOCKS} SELECT path, "offset", CAST(length AS INTEGER) AS length, hash FROM s')
def block_transfer(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return dedup.transfer(objects.blocks(objs, SMALL_BLOCK), objects.blocks(_edited(objs), SMALL_BLOCK))


@query(f"{_BOTH} SELECT path, size, hash FROM a WHERE path NOT IN (SELECT path FROM c)")
def copy_missing(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return dedup.copy_missing(mf.manifest(objs), mf.manifest(_edited(objs)))


@query(f"""WITH {_OBJECTS}, {_BLOCKS}, per AS (SELECT sha256(data) AS hash, count(*) AS n, max(octet_length(data)) AS length FROM blocks GROUP BY 1)
SELECT CAST(sum(n * length) AS BIGINT) AS logical_bytes, CAST(sum(length) AS BIGINT) AS physical_bytes, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS chunks,
CAST(greatest(0, sum(n * length) - sum(length)) AS BIGINT) AS saved_bytes FROM per""")
def chunk_dedup_stats(spark, sf_dir):
    return dedup.stats(objects.blocks(_docs(spark, sf_dir), SMALL_BLOCK))


@query(f"""WITH {_OBJECTS}, {_BLOCKS}, o AS (SELECT path, CAST(sum(octet_length(data)) AS BIGINT) AS size, string_agg(sha256(data), '' ORDER BY "offset") AS ids FROM blocks GROUP BY path)
SELECT objects.path, CAST(420 AS INTEGER) AS mode, coalesce(size, 0) AS size, sha256(coalesce(ids, '')) AS content_hash FROM objects LEFT JOIN o ON objects.path = o.path""")
def object_index(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return objects.object_index(objs, objects.blocks(objs, SMALL_BLOCK)).drop("chunk_ids")


_ARCHIVE = f"""{_OBJECTS}, {_BLOCKS}, per AS (SELECT path, CAST(sum(octet_length(data)) AS BIGINT) AS size, string_agg(sha256(data), '' ORDER BY "offset") AS ids FROM blocks GROUP BY path),
o AS (SELECT objects.path, text, coalesce(size, 0) AS size, sha256(coalesce(ids, '')) AS content_hash, coalesce(ids, '') AS ids FROM objects LEFT JOIN per ON objects.path = per.path),
r AS (SELECT sha256(string_agg(path || ':' || content_hash || ':' || size || chr(10), '' ORDER BY path)) AS root, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM o)"""


def _archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return objects.export(_docs(spark, sf_dir), tables.shared_dir(spark, "archive"), "a-1", 1, SMALL_BLOCK)


@query(f"WITH {_ARCHIVE} SELECT 'a-1' AS archive_id, n AS objects, n AS restored, bytes, root, root AS again, true AS digest_ok FROM r")
def restore_roundtrip(spark, sf_dir):
    return objects.drill(_archive(spark, sf_dir), SMALL_BLOCK).drop("evidence_hash")


@query(f"""WITH {_ARCHIVE}, c AS (SELECT path, bool_or(sha256(data)[1] = '0') AS missing, bool_or(sha256(data)[1] = '1') AS damaged FROM blocks GROUP BY path)
SELECT o.path, CASE WHEN missing THEN 'missing chunk' WHEN damaged THEN 'damaged chunk' END AS error, CASE WHEN NOT (coalesce(missing, false) OR coalesce(damaged, false)) THEN sha256(text) END AS hash
FROM o LEFT JOIN c ON o.path = c.path""")
def restore_faults(spark, sf_dir):
    """Every sixteenth chunk is lost and another sixteenth is damaged."""
    archive = _archive(spark, sf_dir)
    chunks = archive["chunks"].where(~F.col("hash").startswith("0")).withColumn("data", F.when(F.col("hash").startswith("1"), F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))
    return objects.restore(archive | {"chunks": chunks}).select("path", "error", F.sha2("content", 256).alias("hash"))


@query(f"WITH {_ARCHIVE} SELECT 'a-2' AS archive_id, 1::BIGINT AS epoch, root, bytes AS logical_bytes, (SELECT count(*) FROM blocks) AS blocks FROM r")
def archive_clone(spark, sf_dir):
    made = objects.clone(_archive(spark, sf_dir), tables.shared_dir(spark, "archive"), "a-2")
    return made["summary"].select("archive_id", "epoch", "root", "logical_bytes", "blocks")


@query("""SELECT event_id, event_id % 7 NOT IN (1, 4, 5) AS crc_ok, event_id % 7 <> 4 AS parse_ok, event_id % 7 <> 3 AS checksum_ok,
event_id % 7 <> 4 AND event_type <> 'signup' AS kind_known FROM events""")
def log_crc_audit(spark, sf_dir):
    """Lines that are sound, have a malformed (1) or wrong (5) trailer, none (2), a record that its checksum does not fit (3), or are no JSON (4)."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "signup").otherwise("write")
    record = F.to_json(F.struct(F.col("event_id").alias("seq"), F.lit(1).alias("epoch"), kind.alias("kind"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("payload")))
    body = log.with_checksum(record)
    sound, k = log.to_line(body), F.col("event_id") % 7
    wrong = F.concat(F.left(sound, F.length(sound) - 1), F.when(sound.endswith("0"), "1").otherwise("0"))
    line = (
        F.when(k == 1, F.regexp_replace(sound, "[0-9a-f]$", "x")).when(k == 2, body).when(k == 3, log.to_line(F.regexp_replace(body, '"epoch":1', '"epoch":2')))
        .when(k == 4, F.concat(F.lit("#"), sound)).when(k == 5, wrong).otherwise(sound)
    )
    lines = tables.table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    return log.parse(lines).select("event_id", "crc_ok", "parse_ok", "checksum_ok", "kind_known")


@query("""SELECT event_id, user_id FROM events QUALIFY event_id < max(event_id) OVER (PARTITION BY user_id % 8)""")
def torn_tail(spark, sf_dir):
    """Eight logs whose last line has no newline."""
    e, path = tables.table(spark, sf_dir, "events"), tables.shared_dir(spark, "torn")
    line = log.to_line(F.to_json(F.struct(F.col("event_id").alias("seq"), F.lit("write").alias("kind"), F.col("user_id").cast("string").alias("path"))))
    whole = e.groupBy((F.col("user_id") % 8).alias("log")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("rows"))
    whole.select("log", F.array_join(F.transform("rows", lambda x: x["l"]), "\n").alias("value")).write.option("lineSep", "#").partitionBy("log").text(path)
    return log.parse(log.whole_lines(spark, path).select("value")).select(F.col("seq").alias("event_id"), F.col("path").cast("long").alias("user_id"))


@query("SELECT 'n_regionkey=' || n_regionkey || '/n_name=' || replace(n_name, ' ', '%20') AS folder, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS hash FROM nation WHERE n_regionkey <> 1")
def tree_scan(spark, sf_dir):
    """A tree of one file a nation; the folder of region 1 is reserved."""
    path = tables.shared_dir(spark, "tree")
    n = tables.table(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.col("n_name").alias("value"))
    n.write.partitionBy("n_regionkey", "n_name").text(path)
    files = objects.tree(spark, path, ("n_regionkey=1/", "_SUCCESS")).where(F.col("path").rlike("part-"))
    return files.select(F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), " ", "%20").alias("folder"), "length", digests.content_hash(F.col("content")).alias("hash"))


@query("""SELECT user_id, event_id, previous, coalesce(event_id < previous, false) AS regression, coalesce(event_id = previous, false) AS duplicate,
coalesce(greatest(event_id - previous - 1, 0), 0) AS gap FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)""")
def seq_gap_audit(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return log_ops.sequence_audit(events, ["user_id"], "at", "event_id").drop("at")


@query("SELECT max(event_id) + 1 AS next_seq, 1::BIGINT AS epoch, max(user_id) AS fence, count(*) AS records FROM events")
def log_head(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return log_ops.head(e.select(F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("epoch"), F.col("user_id").alias("fence_token")))


@query("""SELECT event_id, seq, op AS client_op_id, min(seq) OVER (PARTITION BY op) AS effective_seq, row_number() OVER (PARTITION BY op ORDER BY seq, event_id) = 1 AS is_first
FROM (SELECT event_id, event_id // 8 AS seq, user_id || '/' || event_type || '/' || props AS op FROM events)""")
def op_dedup(spark, sf_dir):
    """Eight records share each seq; their place in the log tells them apart."""
    e = tables.table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 8").alias("seq"), F.concat_ws("/", "user_id", "event_type", "props").alias("client_op_id"))
    return log_ops.first_of_op(e, tie="event_id")


@query("""SELECT event_id, token, held, held > 0 AND token > 0 AND token < held AS stale FROM (SELECT event_id, token,
coalesce(max(token) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS token FROM events))""")
def fence_audit(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").alias("token"))
    return log_ops.stale_fences(e, ["user_id"], "token", "event_id").drop("user_id")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), h AS (SELECT user_id, count(*) AS hits, round(sum(value), 2) AS bytes, arg_max(ts, event_id) AS last_at FROM events GROUP BY user_id),
g AS (SELECT h.*, (epoch_us(now) - epoch_us(last_at)) / 3600000000.0 AS age_s FROM h, n)
SELECT user_id, hits, bytes, last_at, round(age_s, 6) AS age_s, CASE WHEN hits >= 10 AND age_s < 2 THEN 'HOT' WHEN hits >= 3 AND age_s < 10 THEN 'WARM' WHEN hits >= 1 AND age_s < 60 THEN 'COLD' ELSE 'STATIC' END AS heat,
CASE WHEN hits >= 10 AND age_s < 2 THEN 3 WHEN hits >= 3 AND age_s < 10 THEN 2 WHEN hits >= 1 AND age_s < 60 THEN 1 ELSE 0 END AS heat_rank,
CASE WHEN hits >= 3 AND age_s < 10 THEN 'continuous' ELSE 'baseline' END AS stream FROM g""")
def heat_scores(spark, sf_dir):
    """With hours standing for seconds, as the events lie hours apart."""
    e = tables.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).scalar()
    h = series.partition_paths(series.heat(e, "user_id", "ts", "event_id", "value", now, second_s=3600.0))
    return h.withColumn("bytes", F.round("bytes", 2)).withColumn("age_s", F.round("age_s", 6))


@query("""SELECT user_id, count(*) FILTER (event_id >= 5000) AS lag_ops, CAST(coalesce(sum(greatest(CAST(floor(value) AS BIGINT), octet_length(encode(props)))) FILTER (event_id >= 5000), 0) AS BIGINT) AS lag_bytes,
min(event_id) FILTER (event_id >= 5000) AS oldest_seq, arg_min(ts, event_id) FILTER (event_id >= 5000) AS oldest_at,
round(count(*) FILTER (event_id >= 5000) / 250.0 * 1000, 6) AS eta_ms, count(*) FILTER (event_id >= 5000) = 0 AS ready FROM events GROUP BY user_id""")
def lag_metrics(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").withColumn("size", F.floor("value"))
    out = series.lag_metrics(e, F.lit(5000), ["user_id"], F.lit(250.0), F.lit(True), "event_id", "size", "props", "ts")
    return out.drop("eta_known_ms").withColumn("eta_ms", F.round("eta_ms", 6))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type and hour: counts that stand for backlog and rates."""
    e = tables.table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("event_type", "hour").agg(F.count("*").alias("backlog"), F.count_if(F.col("event_id") % 3 == 0).cast("double").alias("write_rate"), F.count_if(F.col("event_id") % 2 == 0).cast("double").alias("replication_rate"))


_SAMPLES = """s AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS backlog, CAST(count(*) FILTER (event_id % 3 = 0) AS DOUBLE) AS write_rate,
CAST(count(*) FILTER (event_id % 2 = 0) AS DOUBLE) AS replication_rate FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_SAMPLES}, l AS (SELECT *, backlog - lag(backlog) OVER w AS moved, (epoch_us(hour) - epoch_us(lag(hour) OVER w)) / 1e6 AS seconds FROM s WINDOW w AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, hour, backlog, write_rate, replication_rate, round(coalesce(moved / seconds, 0), 9) AS velocity, replication_rate <= write_rate AND backlog > 0 AS non_convergent,
round(CASE WHEN backlog = 0 THEN 0 WHEN replication_rate > write_rate THEN backlog / (replication_rate - write_rate) * 1000 ELSE -1 END, 6) AS eta_ms,
coalesce(moved < 0, false) AS improving, CASE WHEN replication_rate <= write_rate AND backlog > 0 THEN 4 ELSE 0 END AS n_mitigations FROM l""")
def convergence(spark, sf_dir):
    out = series.convergence(_samples(spark, sf_dir), ["event_type"], "hour", "backlog", "write_rate", "replication_rate")
    return out.withColumn("n_mitigations", F.size("mitigations")).drop("mitigations").withColumn("velocity", F.round("velocity", 9)).withColumn("eta_ms", F.round("eta_ms", 6))


@query(f"""WITH {_SAMPLES}, c AS (SELECT event_type, hour, backlog > 3 AND write_rate < 2 AS b, write_rate > 1 AND replication_rate > 0 AS z, backlog > 5 AND replication_rate < 4 AS n, write_rate > 2 AS v FROM s),
k AS (SELECT *, count(*) FILTER (b) OVER w AS kb, count(*) FILTER (z) OVER w AS kz, count(*) FILTER (n) OVER w AS kn, count(*) FILTER (v) OVER w AS kv FROM c WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, hour, CAST(least(512, 64 * pow(2, least(kb, 3))) AS INTEGER) AS batch, b AND kb <= 3 AS batch_changed, kz > 0 AS compression, z AND kz = 1 AS compression_changed,
CAST(least(8, 2 + kn) AS INTEGER) AS concurrency, n AND kn <= 6 AS concurrency_changed, [1000, 500, 250, 125, 62][CAST(least(kv, 4) + 1 AS INTEGER)] AS verify_every, v AND kv <= 4 AS verify_every_changed FROM k""")
def tuning_decisions(spark, sf_dir):
    s = _tuning_samples(spark, sf_dir)
    return series.tuning(s, ["event_type"], "hour", "lag", "rate", "throughput", "cpu", "mem", "storage").drop("lag", "rate", "throughput", "cpu", "mem", "storage")


def _tuning_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select(
        "event_type", "hour", F.when(F.col("backlog") > 5, 501).when(F.col("backlog") > 3, 101).otherwise(0).alias("lag"), F.when(F.col("write_rate") > 1, 101.0).otherwise(0.0).alias("rate"),
        F.col("replication_rate").alias("throughput"), F.when(F.col("write_rate") < 2, 0.1).otherwise(0.9).alias("cpu"), F.when(F.col("replication_rate") < 4, 0.1).otherwise(0.9).alias("mem"), F.when(F.col("write_rate") > 2, 1.0).otherwise(0.0).alias("storage"),
    )


@query("""SELECT user_id, count(*) AS polls, count(*) FILTER (event_type <> 'error') AS healthy_polls, count(*) FILTER (event_type = 'error') AS errors,
coalesce(max(worst), 0) >= 3 AS aborted, coalesce(max(worst), 0) < 3 AND count(*) FILTER (event_type <> 'error') >= 10 AS passed
FROM events LEFT JOIN (SELECT user_id, max(n) AS worst FROM (SELECT user_id, run, count(*) AS n FROM (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) WHERE event_type = 'error' GROUP BY user_id, run) GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def observation_window(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", "failed").alias("err"))
    return series.observation(e, ["user_id"], "ok", "err", "event_id", 10)


_STEP_ROWS = ", ".join(map(str, rules.STEPS))
_PHASE_OF = [*rules.PHASES, *rules.UNSAFE_PHASES]


@query(f"""WITH h AS (SELECT user_id, event_id, [{', '.join(map(repr, _PHASE_OF))}][CAST(event_id * 5 % 14 + 1 AS INTEGER)] AS phase FROM events),
s(from_phase, to_phase) AS (VALUES {_STEP_ROWS}), l AS (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY event_id) AS from_phase FROM h)
SELECT user_id, event_id, from_phase, phase FROM l WHERE from_phase <> phase AND NOT EXISTS (SELECT 1 FROM s WHERE s.from_phase = l.from_phase AND s.to_phase = l.phase)""")
def illegal_transitions(spark, sf_dir):
    steps = spark.createDataFrame(list(rules.STEPS), "from_phase string, to_phase string")
    phase = F.element_at(F.array(*map(F.lit, _PHASE_OF)), (F.col("event_id") * 5 % 14 + 1).cast("int"))
    return series.illegal_steps(tables.table(spark, sf_dir, "events").select("user_id", "event_id", phase.alias("phase")), ["user_id"], "event_id", "phase", steps)


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = tables.table(spark, sf_dir, "orders")
    points = o.where("o_orderkey % 2 = 0").select("o_custkey", (F.col("o_orderkey") % 997).alias("epoch"), F.struct("o_orderdate", "o_orderkey").alias("made"), "o_orderkey")
    wanted = o.where("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 991).alias("wanted"))
    return points, wanted


_ASOF = """WITH p AS (SELECT o_custkey, o_orderkey % 997 AS epoch, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 2 = 0),
q AS (SELECT o_custkey, o_orderkey AS query_id, o_orderkey % 991 AS wanted FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_custkey, query_id, wanted, epoch, o_orderkey FROM (SELECT q.*, p.epoch, p.o_orderkey, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS n
FROM q LEFT JOIN p ON q.o_custkey = p.o_custkey AND p.epoch <= q.wanted) WHERE n = 1"""


@query(_ASOF.format(order="o_orderdate DESC NULLS LAST, p.o_orderkey DESC"))
def asof_point(spark, sf_dir):
    points, wanted = _points(spark, sf_dir)
    return catalog.as_of(points, ["o_custkey"], wanted, "epoch", "made", "wanted").drop("made")


@query(_ASOF.format(order="epoch DESC NULLS LAST, o_orderdate DESC, p.o_orderkey DESC"))
def asof_greatest_epoch(spark, sf_dir):
    points, wanted = _points(spark, sf_dir)
    return catalog.as_of(points, ["o_custkey"], wanted, "epoch", "made", "wanted", greatest_epoch=True).drop("made")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def latest_open(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return catalog.latest_open(o, ["o_custkey"], "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F", ["o_totalprice"])


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def newest_three(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return catalog.row_rank(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).where("rank <= 3")


@query("""SELECT o_orderkey, o_custkey, d.at AS drill_at, d.ok AS drill_ok FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS at, arg_max(l_returnflag = 'N', (l_shipdate, l_returnflag = 'N')) AS ok FROM lineitem GROUP BY l_orderkey) d ON o_orderkey = l_orderkey""")
def attach_drills(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", (F.col("l_returnflag") == "N").alias("ok"))
    return catalog.attach_drills(o, d, "o_orderkey", "l_shipdate", ["ok"]).select("o_orderkey", "o_custkey", F.col("last_drill.l_shipdate").alias("drill_at"), F.col("last_drill.ok").alias("drill_ok"))


@query("""WITH e AS (SELECT o_custkey, count(*) AS archives, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
p AS (SELECT o_custkey, count(*) AS points, bool_or(o_orderstatus = 'P') AS chain FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT o_custkey, coalesce(archives, 0) AS archives, coalesce(points, 0) AS points, coalesce(chain, false) AS journal_chain, st IS NOT NULL AS archive_present, coalesce(st <> 'P', false) AS archive_verified,
coalesce(k % 5 <> 0, false) AS path_known, coalesce(st <> 'O', false) AS drill_recorded, coalesce(st = 'F', false) AS drill_ok,
CASE WHEN st IS NULL THEN 'NOT_RECOVERABLE' WHEN st = 'P' THEN 'PARTIALLY_RECOVERABLE' WHEN k % 5 <> 0 THEN 'RECOVERABLE' ELSE 'UNKNOWN' END AS conclusion FROM e FULL JOIN p USING (o_custkey)""")
def dr_scorecard(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    entries = o.where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderstatus") != "P").alias("ok"), F.when(F.col("o_orderkey") % 5 != 0, "p").otherwise("").alias("path"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("drill"))
    points = o.where("o_orderkey % 3 = 0").select("o_custkey", F.when(F.col("o_orderstatus") == "P", "JOURNAL_CHAIN").otherwise("SNAPSHOT").alias("kind"))
    return catalog.dr_scorecard(entries, points, ["o_custkey"], "o_orderdate", "o_orderkey", "ok", "path", "drill")


_GATE = {
    "lag": "CASE WHEN k % 11 = 0 THEN 3 ELSE 0 END", "pending": "0", "candidate_ok": "k % 13 <> 0", "manifest_ok": "k % 17 <> 0", "journal_ok": "k % 19 <> 0", "rollback_point": "k % 23 <> 0",
    "coordinator_ok": "k % 29 <> 0", "storage_ok": "true", "non_convergent": "k % 31 = 0", "outcome": "CASE k % 7 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'FAILED' WHEN 2 THEN NULL ELSE 'VERIFIED' END",
    "pause_ms": "CASE WHEN k % 37 = 0 THEN 300.0 ELSE 20.0 END", "unverified": "CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END", "override": "k % 2 = 0",
}


@query(f"""WITH i AS (SELECT o_orderkey, {', '.join(f'{v} AS "{k}"' for k, v in _GATE.items())} FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)),
f AS (SELECT *, lag > 0 OR pending > 0 OR NOT manifest_ok OR NOT rollback_point OR NOT (coordinator_ok AND storage_ok) OR coalesce(outcome, 'UNKNOWN') NOT IN ('VERIFIED', 'PARTIAL', 'UNKNOWN') AS soft,
NOT candidate_ok OR NOT journal_ok OR non_convergent OR outcome IS NULL OR pause_ms > 250 AS hard, coalesce(outcome = 'PARTIAL', false) OR unverified > 0 AS needs FROM i)
SELECT o_orderkey, CASE WHEN (soft OR hard) AND NOT (override AND needs AND NOT hard) THEN 'BLOCKED' WHEN needs AND NOT override THEN 'REQUIRES_OVERRIDE' ELSE 'ALLOWED' END AS decision,
CASE WHEN soft OR hard THEN 'BLOCKED' WHEN needs AND NOT override THEN 'REQUIRES_OVERRIDE' ELSE 'ALLOWED' END AS strict_decision,
(lag > 0 OR pending > 0)::INT + (NOT candidate_ok)::INT + (NOT manifest_ok)::INT + (NOT journal_ok)::INT + (NOT rollback_point)::INT + (NOT (coordinator_ok AND storage_ok))::INT + non_convergent::INT + (outcome IS NULL)::INT
+ coalesce(outcome = 'FAILED', false)::INT + (pause_ms > 250)::INT + coalesce(outcome = 'PARTIAL', false)::INT + (unverified > 0)::INT AS n_reasons FROM f""")
def gate_decisions(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    reasons, decision, strict = rules.gate({k: F.expr(v) for k, v in _GATE.items()})
    return o.select("o_orderkey", decision.alias("decision"), strict.alias("strict_decision"), F.size(reasons).alias("n_reasons"))


@query("""WITH i AS (SELECT o_orderkey, o_totalprice * 1000 AS bytes, o_orderkey % 40 AS files, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 1000000.0 END AS bandwidth, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 400.0 END AS history,
CAST(o_orderkey % 450 AS DOUBLE) AS write_rate, CASE WHEN o_orderkey % 9 = 0 THEN 100000000.0 ELSE 0.0 END AS capacity, o_orderkey % 14 <> 0 AS can_verify FROM orders),
j AS (SELECT *, CASE WHEN bandwidth > 0 THEN bandwidth ELSE 33554432.0 END AS bw, CASE WHEN history > 0 THEN history ELSE 5000.0 END AS h FROM i)
SELECT o_orderkey, round(CASE WHEN h > write_rate AND files > 0 THEN bytes / bw * write_rate / h * 1000 + bytes / bw * 1000 WHEN h <= write_rate AND write_rate > 0 THEN -1 ELSE 0 END, 6) AS catchup_ms,
round(5 + write_rate / h * 40, 6) AS pause_ms, CASE WHEN (capacity > 0 AND bytes > capacity) OR NOT can_verify THEN 'BLOCKED' WHEN write_rate > 0 AND write_rate >= h THEN 'LIKELY_NON_CONVERGENT' WHEN write_rate > h * 0.7 THEN 'READY_WITH_RISK'
WHEN 5 + write_rate / h * 40 > 250 THEN 'READY_WITH_RISK' ELSE 'READY' END AS conclusion,
CAST(CASE WHEN capacity > 0 AND bytes > capacity THEN 0.95 WHEN NOT can_verify THEN 0.7 WHEN write_rate > 0 AND write_rate >= h THEN 0.8 WHEN write_rate > h * 0.7 THEN 0.6 WHEN files = 0 AND bytes = 0 AND write_rate = 0 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM j""")
def migration_plan(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    out = rules.plan({
        "bytes": F.col("o_totalprice") * 1000, "files": k % 40, "bandwidth": F.when(k % 4 == 0, 0.0).otherwise(1e6), "history": F.when(k % 5 == 0, 0.0).otherwise(400.0),
        "write_rate": (k % 450).cast("double"), "capacity": F.when(k % 9 == 0, 1e8).otherwise(0.0), "can_verify": k % 14 != 0,
    })
    return o.select("o_orderkey", F.round(out["catchup_ms"], 6).alias("catchup_ms"), F.round(out["pause_ms"], 6).alias("pause_ms"), out["conclusion"].alias("conclusion"), out["confidence"].alias("confidence"))


_PHASES = (*rules.PHASES, *rules.UNSAFE_PHASES, "OTHER")
_PHASE_SQL = f"[{', '.join(repr(p) for p in _PHASES)}][CAST(o_orderkey % {len(_PHASES)} + 1 AS INTEGER)]"


@query(f"""WITH i AS (SELECT o_orderkey, {_PHASE_SQL} AS phase, o_orderkey // 15 % 3 AS writes, o_orderkey % 2 = 0 AS promoted, o_orderkey % 7 <> 0 AS standby_ok, o_orderkey % 11 <> 0 AS manifest_ok, o_orderkey % 13 <> 0 AS journal_ok, o_orderkey % 4 = 0 AS failed FROM orders),
j AS (SELECT *, phase IN ('CUTOVER', 'OBSERVING', 'RECOVERING') AS late, phase IN ('SYNCHRONIZING', 'VERIFYING', 'QUIESCING', 'FINAL_DELTA') AS early FROM i)
SELECT o_orderkey, phase, CASE WHEN phase IN ('ACTIVE', 'CHECKPOINT', 'SHADOW', 'SYNCHRONIZING', 'VERIFYING') THEN 'RETRY' WHEN phase IN ('QUIESCING', 'FINAL_DELTA') THEN 'ABORT' WHEN phase = 'CUTOVER' AND writes > 0 THEN 'RECONCILE'
WHEN phase = 'CUTOVER' THEN 'ROLLBACK' WHEN phase = 'OBSERVING' THEN 'RESUME' WHEN phase IN ('RECOVERING', 'DEGRADED') THEN 'RECONCILE' ELSE 'ABORT' END AS action,
CASE WHEN late AND promoted AND writes > 0 THEN 'RECONCILE' WHEN late AND promoted AND failed AND standby_ok AND writes = 0 THEN 'ROLLBACK' WHEN late AND NOT promoted AND journal_ok THEN 'RESUME' WHEN late THEN 'RETRY'
WHEN early AND NOT (journal_ok AND manifest_ok) THEN 'ABORT' WHEN early THEN 'RESUME' ELSE 'ABORT' END AS evidence_action,
CASE WHEN late AND promoted AND writes > 0 THEN 'MANUAL_RECONCILIATION' WHEN late AND promoted AND failed AND standby_ok AND writes = 0 THEN 'ROLLBACK_SAFE' WHEN late THEN 'FORWARD_RECOVERY'
WHEN early AND NOT (journal_ok AND manifest_ok) THEN 'ROLLBACK_SAFE' WHEN early THEN 'FORWARD_RECOVERY' ELSE 'MANUAL_RECONCILIATION' END AS evidence_class,
CASE WHEN writes = 0 THEN 'SAFE' WHEN phase IN ('OBSERVING', 'CUTOVER') THEN 'REQUIRES_RECONCILIATION' ELSE 'UNSAFE' END AS rollback,
phase IN ('COMMITTED', 'ABORTED', 'ROLLED_BACK') AS terminal, phase IN ('ABORTED', 'DEGRADED', 'RECOVERING', 'ROLLED_BACK') AS unsafe FROM j""")
def recovery_decision(spark, sf_dir):
    k = F.col("o_orderkey")
    phase = F.element_at(F.array(*map(F.lit, _PHASES)), (k % len(_PHASES) + 1).cast("int"))
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", phase.alias("phase"), (F.floor(k / 15) % 3).alias("writes"))
    p, w = F.col("phase"), F.col("writes")
    action, kind = rules.recovery_class(p, w, k % 2 == 0, k % 7 != 0, k % 11 != 0, k % 13 != 0, k % 4 == 0)
    return o.select("o_orderkey", "phase", rules.recovery_action(p, w).alias("action"), action.alias("evidence_action"), kind.alias("evidence_class"), rules.rollback_safety(w, p).alias("rollback"), rules.is_terminal(p).alias("terminal"), rules.is_unsafe(p).alias("unsafe"))


_CAPS = ("snapshot", "incremental-snapshot", "change-tracking", "block-read", "freeze", "checksum", "atomic-rename", "copy-on-write")


@query(f"""WITH c AS (SELECT o_orderkey, {', '.join(f"(o_orderkey >> {i}) % 2 = 1 AS c{i}" for i in range(len(_CAPS)))} FROM orders)
SELECT o_orderkey, (CASE WHEN c0 OR c1 THEN 'snapshot-seed' ELSE 'baseline-copy' END) || (CASE WHEN c2 OR c3 THEN ',block-differential' ELSE ',journal-replay' END) || (CASE WHEN c4 THEN ',write-barrier-freeze' ELSE '' END)
|| (CASE WHEN c5 THEN ',checksum-verify' ELSE '' END) || (CASE WHEN c6 THEN ',atomic-pointer-cutover' ELSE '' END) || (CASE WHEN c7 THEN ',cow-candidate' ELSE '' END) AS strategies,
(CASE WHEN c5 THEN 'checksum' ELSE '' END) || (CASE WHEN c5 AND c4 THEN ',' ELSE '' END) || (CASE WHEN c4 THEN 'freeze' ELSE '' END) AS negotiated,
(CASE WHEN NOT c5 THEN 'checksum' ELSE '' END) || (CASE WHEN NOT c5 AND NOT c4 THEN ',' ELSE '' END) || (CASE WHEN NOT c4 THEN 'freeze' ELSE '' END) AS missing FROM c""")
def strategy_select(spark, sf_dir):
    caps = F.array_compact(F.array(*[F.when(F.shiftright("o_orderkey", i) % 2 == 1, c) for i, c in enumerate(_CAPS)]))
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", caps.alias("caps"))
    negotiated, missing = catalog.capability_match(F.col("caps"), F.array(F.lit("freeze"), F.lit("checksum")))
    return o.select("o_orderkey", F.array_join(rules.strategies(F.col("caps")), ",").alias("strategies"), F.array_join(negotiated, ",").alias("negotiated"), F.array_join(missing, ",").alias("missing"))


@query("SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}', '[REDACTED_EMAIL]', 'g') AS text, regexp_matches(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}') AS changed FROM documents")
def redact_emails(spark, sf_dir):
    return text.redact(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [text.redact_emails])


@query(r"""SELECT doc_id, regexp_replace(text, '(?i)("?(?:api[_-]?key|password|secret|token)"?\s*[:=]\s*)("?)[^"\s,}\]]+("?)', '\1\2[TOKENIZED]\3', 'g') AS text FROM documents""")
def tokenize_secrets(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.tokenize_secrets(F.col("text")).alias("text"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'degraded' ELSE 'unknown' END AS integrity, o_orderstatus = 'F' AS verified, CAST(sign(o_custkey % 5 - 2) AS INTEGER) AS epoch_order, o_custkey % 5 < 2 OR (o_custkey % 5 = 2 AND o_orderkey % 5 < 3) AS stale, left(o_orderpriority, 7) AS short_id FROM orders")
def predicates(spark, sf_dir):
    outcome = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "PARTIAL")
    e, t = F.col("o_custkey") % 5, F.col("o_orderkey") % 5
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", rules.integrity_label(outcome).alias("integrity"), rules.is_verified(outcome).alias("verified"), rules.compare_epochs(e, F.lit(2)).alias("epoch_order"), rules.is_stale_fence(e, t, F.lit(2).cast("long"), F.lit(3).cast("long")).alias("stale"), text.short_id(F.col("o_orderpriority")).alias("short_id"))


@query(f"""WITH {_OBJECTS}, {_BLOCKS}, o AS (SELECT path, CAST(sum(octet_length(data)) AS BIGINT) AS size, string_agg(sha256(data), '' ORDER BY "offset") AS ids FROM blocks GROUP BY path)
SELECT sha256(string_agg(objects.path || ':' || sha256(coalesce(ids, '')) || ':' || coalesce(size, 0) || chr(10), '' ORDER BY objects.path)) AS root FROM objects LEFT JOIN o ON objects.path = o.path""")
def archive_root(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    return digests.archive_root(objects.object_index(objs, objects.blocks(objs, SMALL_BLOCK)))


_CLEAN = r"""regexp_replace(regexp_replace(coalesce(text, ''), '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', '[REDACTED_EMAIL]', 'g'),
  '(?i)("?(?:api[_-]?key|password|secret|token)"?\s*[:=]\s*)("?)[^"\s,}\]]+("?)', '\1\2[TOKENIZED]\3', 'g')"""


@query(f"""WITH objects AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, doc_id AS k, coalesce(text, '') AS was, {_CLEAN} AS text FROM documents), {_BLOCKS}
SELECT 'a-2' AS archive_id, (SELECT count(*) FROM objects WHERE was <> text) AS changed_objects, (SELECT count(*) FROM blocks) AS blocks, (SELECT count(DISTINCT sha256(data)) FROM blocks) AS chunks""")
def sanitised_clone(spark, sf_dir):
    made = objects.sanitised_clone(_archive(spark, sf_dir), tables.shared_dir(spark, "archive"), "a-2", [text.redact_emails, text.tokenize_secrets], SMALL_BLOCK)
    return made["summary"].select("archive_id", "changed_objects", "blocks", "chunks")


@query("SELECT event_id AS seq, event_type AS kind, CAST(user_id AS VARCHAR) AS path, props AS payload FROM events WHERE event_id BETWEEN 100 AND 400")
def log_range_scan(spark, sf_dir):
    path = tables.shared_dir(spark, "log")
    e = tables.table(spark, sf_dir, "events")
    log.write(e.select(F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("epoch"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("payload")), path)
    return log.scan(spark, path, 100, 400).select("seq", "kind", "path", "payload")


@query("SELECT event_id AS seq, event_type AS kind, CAST(user_id AS VARCHAR) AS path, props AS payload FROM events WHERE event_id BETWEEN 700 AND 900")
def log_segment_scan(spark, sf_dir):
    """A range that lies in the segments of two appends; the second append comes twice, as after a failure."""
    e = tables.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("epoch"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("payload"))
    held = segments.SegmentedLog(spark, tables.shared_dir(spark, "segments"), 5000)
    for batch in (0, 1, 1):
        held.append(rows.where((F.col("seq") >= 800) == bool(batch)), batch)
    return held.scan(700, 900).select("seq", "kind", "path", "payload")


@query("""WITH e AS (SELECT event_id, user_id AS u, user_id % 10 AS r, event_type, props FROM events WHERE user_id % 10 <> 8 OR event_id < 5000),
gone AS (SELECT u, max(event_id) AS d FROM e WHERE event_type = 'error' GROUP BY u),
f AS (SELECT u, r, event_type, max(event_id) AS s, arg_max(props, event_id) AS p FROM e WHERE event_type <> 'error' GROUP BY u, r, event_type),
tail AS (SELECT DISTINCT user_id AS u, user_id % 10 AS r FROM events WHERE user_id % 10 <> 8 AND user_id % 3 <> 2),
files AS (SELECT f.u, r, event_type AS name, 420 AS mode, p AS content_hash, s AS size FROM f LEFT JOIN gone ON f.u = gone.u WHERE d IS NULL OR s > d
  UNION ALL SELECT u, r, 'last', CASE WHEN u % 6 = 1 THEN 384 ELSE 420 END, 'tail', 1 FROM tail),
n AS (SELECT r, sum(n) AS n FROM (SELECT r, count(*) AS n FROM e GROUP BY r UNION ALL SELECT r, 2 * count(*) FROM tail GROUP BY r) GROUP BY r)
SELECT CAST(files.r AS VARCHAR) AS resource, (CASE WHEN u % 3 = 0 AND files.r <> 8 THEN 'e' ELSE 'd' END) || u || '/' || name AS path, CAST(mode AS INTEGER) AS mode, content_hash, size, CAST(n AS BIGINT) AS applied,
CASE files.r WHEN 7 THEN 'unknown kind frobnicate' WHEN 8 THEN 'no such path none' WHEN 9 THEN 'range writes are not supported' END AS error FROM files JOIN n ON files.r = n.r""")
def log_replay(spark, sf_dir):
    """A folder a user: an error deletes it, every third user's is renamed in the end, and every third has a file whose mode changes (0: to the default); three resources end in an error, one of them early."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    u, gone = F.col("user_id"), F.col("event_type") == "error"
    folder = F.concat(F.lit("d"), u.cast("string"))
    names = ("seq", "resource", "kind", "path", "dest_path", "mode", "offset", "size", "content_hash")

    def records(rows: DataFrame, *values) -> DataFrame:
        kinds = ("long", "string", "string", "string", "string", "int", "long", "long", "string")
        return rows.select(*[(v if hasattr(v, "cast") else F.lit(v)).cast(k).alias(n) for n, k, v in zip(names, kinds, values, strict=True)])

    users, r = e.select("user_id").distinct(), (u % 10).cast("string")
    third = users.where("user_id % 3 <> 2")
    last = F.concat(folder, F.lit("/last"))
    one = users.groupBy().count()  # one row
    out = (
        records(e, 2 * F.col("event_id"), r, F.when(gone, "delete").otherwise("write"), F.when(gone, folder).otherwise(F.concat(folder, F.lit("/"), "event_type")), "", 0, 0, F.col("event_id"), F.col("props"))
        .unionByName(records(third, 10**9 + 2 * u, r, "write", last, "", 0, 0, 1, "tail"))
        .unionByName(records(third.where("user_id % 3 = 0"), 10**9 + 2 * u + 1, r, "rename", folder, F.concat(F.lit("e"), u.cast("string")), 0, 0, 0, ""))
        .unionByName(records(third.where("user_id % 3 = 1"), 10**9 + 2 * u + 1, r, "chmod", last, "", F.when(u % 2 == 1, 384).otherwise(0), 0, 0, ""))
        .unionByName(records(one, 2 * 10**9, "7", "frobnicate", "x", "", 0, 0, 0, ""))
        .unionByName(records(one, 9999, "8", "chmod", "none", "", 384, 0, 0, ""))
        .unionByName(records(one, 2 * 10**9, "9", "write", "x", "", 0, 7, 0, ""))
    )
    written = tables.materialise(out, "replay-log")
    return log_ops.replay(written).where("path is not null").select("resource", "path", "mode", "content_hash", "size", "applied", "error")


_REFUSED = """e AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '' ELSE user_id || '/' || event_type || '/' || props END AS op, CAST(floor(value) AS BIGINT) AS token FROM events)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they arrive: tokens from 0 on, so many are refused and come again, and some have no op id."""
    op = F.when(F.col("event_id") % 97 == 0, "").otherwise(F.concat_ws("/", "user_id", "event_type", "props"))
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("arrival"), op.alias("client_op_id"), F.floor("value").alias("fence_token"))


@query(f"""WITH {_REFUSED}, came AS (SELECT * FROM e WHERE event_id >= 500 UNION ALL SELECT * FROM e WHERE event_id >= 500 AND event_id % 50 = 0),
valid AS (SELECT * FROM came WHERE (token = 0 OR token >= 40) AND (op = '' OR op NOT IN (SELECT op FROM e WHERE event_id < 500))),
fresh AS (SELECT op, token, event_id FROM valid WHERE op = '' UNION ALL SELECT op, arg_min(token, event_id), min(event_id) FROM valid WHERE op <> '' GROUP BY op)
SELECT op AS client_op_id, CASE token WHEN 0 THEN 40 ELSE token END AS fence_token, 3::BIGINT AS epoch, 499 + row_number() OVER (ORDER BY event_id) AS seq FROM fresh""")
def log_append(spark, sf_dir):
    """Onto a log whose own fence is 40; some records arrive twice at once."""
    e = _arrivals(spark, sf_dir)
    log_ = e.where("arrival < 500").select(F.col("arrival").alias("seq"), "client_op_id", F.least("fence_token", F.lit(40).cast("long")).alias("fence_token"), F.lit(3).cast("long").alias("epoch"))
    incoming = e.where("arrival >= 500")
    return log_ops.append(log_, incoming.unionByName(incoming.where("arrival % 50 = 0"))).select("client_op_id", "fence_token", "epoch", "seq")


_ACTION = "CASE event_type WHEN 'error' THEN 'rollback' WHEN 'signup' THEN 'advance' WHEN 'view' THEN 'force' ELSE 'commit' END"


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, {_ACTION} AS action, event_id % 7 AS pin FROM events),
l AS (SELECT user_id, list(CASE action WHEN 'commit' THEN -1 WHEN 'advance' THEN pin ELSE 1000000000 + pin END ORDER BY event_id) AS c FROM e GROUP BY user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
a AS (SELECT k.*, CAST(list_reduce(list_prepend(0, c[1:k]), lambda x, y: CASE WHEN y = -1 THEN x + 1 WHEN y >= 1000000000 THEN y - 1000000000 ELSE greatest(x, y) END) AS BIGINT) AS assigned FROM k JOIN l ON k.user_id = l.user_id)
SELECT user_id, event_id, action, assigned, action = 'advance' AND pin < coalesce(lag(assigned) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS refused FROM a""")
def epoch_assignment(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_ACTION).alias("action"), (F.col("event_id") % 7).alias("pin"))
    return log_ops.epochs(e, "user_id", "event_id", "action", "pin")


@query(f"""WITH {_REFUSED}, valid AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM e WHERE token = 0 OR token >= 40),
fresh AS (SELECT * FROM valid WHERE op = '' UNION ALL SELECT * FROM valid WHERE op <> '' QUALIFY row_number() OVER (PARTITION BY op ORDER BY batch, event_id) = 1)
SELECT op AS client_op_id, CASE token WHEN 0 THEN 40 ELSE token END AS fence_token, row_number() OVER (ORDER BY batch, event_id) AS seq FROM fresh""")
def append_sink(spark, sf_dir):
    """Two batches into a written log, the second one twice, as after a failure."""
    e = _arrivals(spark, sf_dir)
    sink = log_ops.LogSink(spark, tables.shared_dir(spark, "log-sink"), "seq long, epoch long, fence_token long, client_op_id string", fence=40)
    for batch in (1, 2, 2):
        sink.write(e.where(F.col("arrival") % 2 == batch - 1), batch)
    return sink.read().select("client_op_id", "fence_token", "seq")


@query("""SELECT * FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id < 800 GROUP BY user_id) WHERE event_type <> 'error'""")
def final_delta(spark, sf_dir):
    """The state at one cursor, brought up to a barrier; the records before the cursor are delivered once more."""
    e = tables.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    names = ("user_id", "seq", "event_type", "error", ["value"])
    state = log_ops.latest(log_ops.delta(e, 0, 300), *names)
    return log_ops.caught_up(state, log_ops.delta(e, 250, 800), *names).withColumnRenamed("seq", "event_id")


@query("""SELECT o_orderkey AS scenario, o_orderkey % 2 = 0 AS expect_detection, coalesce(o_orderkey % 3 <> 0 AND (o_orderkey % 2 = 0) = (o_orderkey % 4 = 0) AND o_orderkey % 5 <> 0, false) AS passed FROM orders""")
def chaos_matrix(spark, sf_dir):
    k = F.col("o_orderkey")
    o = tables.table(spark, sf_dir, "orders").select(k)
    expected = o.select(k.alias("scenario"), (k % 2 == 0).alias("expect_detection"), F.lit("RETRY").alias("expect_action"))
    actual = o.where(k % 3 != 0).select(k.alias("scenario"), (k % 4 == 0).alias("detected"), (k % 5 != 0).alias("recovered"), F.lit("RETRY").alias("action_taken"))
    return catalog.chaos_matrix(expected, actual).select("scenario", "expect_detection", "passed")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN '[x] ' WHEN 'signup' THEN '[!] ' WHEN 'purchase' THEN '[+] ' ELSE '[.] ' END || props AS line, 1 AS schema_version FROM events")
def event_lines(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").when(F.col("event_type") == "purchase", "success").otherwise("info")
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", text.event_line(level, F.col("props")).alias("line"), text.envelope(F.struct("props"))["schema_version"].alias("schema_version"))


@query("SELECT o_orderkey, 'write_pause' AS name, o_totalprice AS value, 'ms' AS unit FROM orders UNION ALL SELECT o_orderkey, 'barrier_pause', o_totalprice / 2, 'ms' FROM orders")
def pause_metrics(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("write_pause"), (F.col("o_totalprice") / 2).alias("barrier_pause"))
    return text.pause_metrics(o, "write_pause", "barrier_pause")


@query("SELECT event_type AS name, arg_min(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY 1")
def first_metric(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", F.struct("ts", "event_id").alias("ts"))
    return catalog.first_metric(e, "view")


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'active' WHEN c_custkey % 3 = 0 THEN 'standby' ELSE 'shadow' END AS role FROM customer")
def slot_roles(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("shadow").alias("role"))
    return log_ops.promoted(c, "c_custkey", "role", 7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <> 5")
def prune_entry(spark, sf_dir):
    return catalog.prune(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5)


_ROOT = "(SELECT sha256(coalesce(string_agg(path || ':' || hash || chr(10), '' ORDER BY path), '')) FROM {0}) AS {1}_root, (SELECT count(*) FROM {0}) AS {1}_files, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM {0}) AS {1}_bytes"


@query(f"""{_BOTH}, x AS (SELECT 'edited' AS candidate, {_ROOT.format("a", "active")}, {_ROOT.format("c", "candidate")} UNION ALL SELECT 'same', {_ROOT.format("a", "active")}, {_ROOT.format("a", "candidate")})
SELECT *, active_root = candidate_root AND active_files = candidate_files AND active_bytes = candidate_bytes AS equal FROM x""")
def manifest_equal(spark, sf_dir):
    objs = _docs(spark, sf_dir)
    active = mf.manifest(objs)
    return mf.equal(active, mf.manifest(_edited(objs))).withColumn("candidate", F.lit("edited")).unionByName(mf.equal(active, active).withColumn("candidate", F.lit("same")))


@query(f"WITH {_OBJECTS}, {_BLOCKS}, h AS (SELECT DISTINCT sha256(data) AS hash FROM blocks) SELECT hash, CASE hash[1] WHEN '0' THEN 'missing' ELSE 'mismatch' END AS fault FROM h WHERE hash[1] IN ('0', '1')")
def chunk_faults(spark, sf_dir):
    cut = objects.blocks(_docs(spark, sf_dir), SMALL_BLOCK, keep_data=True)
    held = dedup.first_chunks(cut).where(~F.col("hash").startswith("0"))
    return dedup.chunk_faults(cut, held.withColumn("data", F.when(F.col("hash").startswith("1"), F.concat("data", F.lit(b"?"))).otherwise(F.col("data"))))


def _resumed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str, **options) -> DataFrame:
    """A stream over files of events, two a batch, that stops half way and resumes from its folder when the other half has come."""
    base = tables.shared_dir(spark, "events")
    e = tables.table(spark, sf_dir, "events")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{base}/in")
        out = stream.run_to_table(build(stream.read(spark, f"{base}/in", 2)), mode, folder=f"{base}/run", **options)
    return out


@query(ORACLE_SQL["lww_state"])
def stream_lww(spark, sf_dir):
    return _resumed(spark, sf_dir, lambda e: stream.latest(e, "user_id", "event_id", ["event_type", "value"]), "complete").where("event_type <> 'error'")


@query("SELECT user_id, count(*) AS hits, round(sum(value), 2) AS bytes, arg_max(ts, event_id) AS last_at FROM events GROUP BY user_id")
def stream_heat(spark, sf_dir):
    return _resumed(spark, sf_dir, lambda e: stream.heat(e, "user_id", "ts", "event_id", "value"), "complete", every="0 seconds").withColumn("bytes", F.round("bytes", 2))


@query("SELECT DISTINCT user_id || '/' || event_type || '/' || props AS client_op_id FROM events")
def stream_op_dedup(spark, sf_dir):
    def build(e):
        return stream.first_of_op(e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type", "props").alias("client_op_id")), "client_op_id", "ts", "365 days")

    return _resumed(spark, sf_dir, build, "append").select("client_op_id")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    out = _resumed(spark, sf_dir, lambda e: stream.windows(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], "value"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    out = _resumed(spark, sf_dir, lambda e: stream.windows(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], "value", slide="3 hours"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH s AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    out = _resumed(spark, sf_dir, lambda e: stream.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"], "value", "3650 days"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 2).alias("total"))


@query("""WITH k AS (SELECT user_id, count(*) AS samples, count(*) FILTER (value > 50) AS b, count(*) FILTER (value > 80) AS n FROM events GROUP BY user_id)
SELECT user_id, samples, CAST(least(512, 64 * pow(2, least(b, 3))) AS INTEGER) AS batch, CAST(least(8, 2 + n) AS INTEGER) AS concurrency FROM k""")
def stream_tuning(spark, sf_dir):
    """The knobs as they stand after each batch follow from how often their conditions have held."""
    held = _resumed(spark, sf_dir, lambda e: stream.held_conditions(e, ["user_id"], {"b": F.col("value") > 50, "n": F.col("value") > 80}), "complete")
    return held.select("user_id", "samples", rules.tuned(F.col("b"), "batch").alias("batch"), rules.tuned(F.col("n"), "concurrency").alias("concurrency"))


@query(ORACLE_SQL["tuning_decisions"])
def stream_tuning_decisions(spark, sf_dir):
    """All four knobs after each sample from state that outlives a stop: the earlier hours first, the later ones after a restart."""
    base, cut = tables.shared_dir(spark, "samples"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    samples = _tuning_samples(spark, sf_dir)
    for earlier in (True, False):
        samples.where((F.col("hour") < cut) == F.lit(earlier)).repartition(3).write.mode("append").parquet(f"{base}/in")
        found = state.running(stream.read(spark, f"{base}/in", 64), ["event_type"], "hour", series.tuning_conditions("lag", "rate", "throughput", "cpu", "mem", "storage"))
        out = stream.run_to_table(found, "append", folder=f"{base}/run", rocksdb=True)
    for knob in ("batch", "compression", "concurrency", "verify_every"):
        now = F.col(f"{knob}_so_far")
        was = now - F.when(F.col(f"{knob}_held"), 1).otherwise(0)
        out = out.withColumn(knob, rules.tuned(now, knob)).withColumn(f"{knob}_changed", rules.tuned(now, knob) != rules.tuned(was, knob))
    return out.select("event_type", "hour", *[c for k in ("batch", "compression", "concurrency", "verify_every") for c in (k, f"{k}_changed")])


@query("""SELECT 'p' || o_orderkey AS id, o_orderkey % 97 AS epoch, CASE WHEN o_orderkey % 4 = 0 THEN 'JOURNAL_CHAIN' ELSE 'SNAPSHOT' END AS kind, CASE WHEN o_orderkey % 6 = 0 THEN 'again' ELSE '' END AS note
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def recovery_point_store(spark, sf_dir):
    """Recovery points that two writers put from the same version; where they meet in keys the later one reads again and retries."""
    o = tables.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), "o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderkey") % 97).cast("long").alias("epoch"), F.col("o_orderkey").cast("long").alias("journal_position"),
        F.lit("a").alias("archive_path"), F.lit("r").alias("root_digest"), F.when(F.col("o_orderkey") % 4 == 0, "JOURNAL_CHAIN").otherwise("SNAPSHOT").alias("kind"), F.lit("").alias("note"),
    )
    uri, k = tables.shared_dir(spark, "points"), F.col("journal_position")
    one, two = (tables.Store(spark, uri, schema.RECOVERY_POINT, "id") for _ in range(2))
    base = one.head()
    one.put(o.where(k % 6 == 2), base)
    two.put(o.where(k % 6 == 3), base)  # other keys: both stand
    one.put(o.where((k % 6 == 4) | (k % 6 == 0)), base)
    again = o.where(k % 6 == 0).withColumn("note", F.lit("again"))
    try:
        two.put(again, base)
    except tables.Conflict:
        two.put(again, two.head())
    return two.load().select("id", "epoch", "kind", "note")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS resource, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS epoch, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END AS token FROM customer WHERE c_custkey <> 3""")
def fence_store(spark, sf_dir):
    """A fence for each customer; some are raised, one is given up."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("resource"), F.lit(1).cast("long").alias("epoch"), F.col("c_custkey").cast("long").alias("token"), F.lit("h").alias("holder"))
    store = tables.Store(spark, tables.shared_dir(spark, "fences"), schema.FENCE, "resource")
    store.put(c)
    raised = store.load().where("token % 5 = 0").select("resource", (F.col("epoch") + 1).alias("epoch"), (F.col("token") + 1).alias("token"), "holder")
    store.put(raised)
    return store.delete("3").select("resource", "epoch", "token")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)
SELECT * FROM b WHERE o_orderkey <> 6""")
def catalog_store(spark, sf_dir):
    """Entries put into a stored catalog, some of them replaced, one removed."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    store = tables.Store(spark, tables.shared_dir(spark, "catalog"), "o_orderkey long, o_custkey long, o_totalprice double", "o_orderkey")
    store.put(o.where("o_orderkey % 2 = 0"))
    store.put(o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2))
    return store.delete(6)


@query("""SELECT c_custkey AS o_orderkey, o_custkey, o_orderkey IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_orderkey = c_custkey""")
def catalog_lookup(spark, sf_dir):
    wanted = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    return catalog.lookup(wanted, tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(f"WITH m AS ({ORACLE_SQL['chaos_matrix']}) SELECT count(*) AS scenarios, count(*) FILTER (passed) AS passed, bool_and(passed) AS all_passed FROM m")
def chaos_score(spark, sf_dir):
    return catalog.chaos_score(QUERIES["chaos_matrix"](spark, sf_dir))


@query(f"WITH {_SAMPLES} SELECT event_type, count(*) AS samples FROM s GROUP BY event_type")
def history_length(spark, sf_dir):
    return series.history_length(_samples(spark, sf_dir), ["event_type"])


@query("""SELECT o_orderkey, printf('%-14s %-10s epoch=%d bytes=%d %s', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderkey % 9, CAST(floor(o_totalprice) AS BIGINT), CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'unverified' END) AS line,
printf('%s: %s, %d mutations, pause %.3f ms', o_orderkey::VARCHAR, o_orderstatus, o_custkey, (o_orderkey % 1000) / 8.0) AS receipt FROM orders""")
def catalog_lines(spark, sf_dir):
    o, k = tables.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = text.catalog_line(k.cast("string"), F.col("o_custkey").cast("string"), k % 9, F.floor("o_totalprice"), F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", line.alias("line"), text.receipt_line(k.cast("string"), F.col("o_orderstatus"), F.col("o_custkey"), (k % 1000) / 8.0).alias("receipt"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE doc_id % 2 = 0 END AS is_text, doc_id % 4 < 2 AS ready, doc_id % 5 < 2 AS recoverable, doc_id % 6 = 0 AS allowed,
doc_id / 1000.0 AS ms, 5 + (doc_id % 50) / (CASE WHEN doc_id % 8 > 0 THEN CAST(doc_id % 8 AS DOUBLE) ELSE 1.0 END) * 1000 + (doc_id % 90) * 0.02 AS pause_ms, doc_id % 2 = 0 AS is_archive FROM documents""")
def predicates_of_documents(spark, sf_dir):
    """Text by extension (upper case), text by content, and content with a NUL where the id is odd."""
    k = F.col("doc_id")
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    path = F.concat(k.cast("string"), F.when(k % 3 == 0, ".JSON").otherwise(".bin"))
    content = F.when(k % 3 == 1, body).when(k % 2 == 0, body).otherwise(F.concat(F.lit(b"a\0"), body))
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", rules.looks_like_text(path, content).alias("is_text"), rules.is_ready(pick(4, "READY", "READY_WITH_RISK", "BLOCKED", "UNKNOWN")).alias("ready"),
        rules.is_recoverable(pick(5, "RECOVERABLE", "PARTIALLY_RECOVERABLE", "NOT_RECOVERABLE", "UNKNOWN", "")).alias("recoverable"), rules.gate_allows(pick(6, "ALLOWED", "BLOCKED", "", "allowed", "REQUIRES_OVERRIDE", "x")).alias("allowed"),
        text.micros_to_ms(k).alias("ms"), rules.live_pause_ms(k % 50, (k % 8).cast("double"), k % 90).alias("pause_ms"), objects.is_archive(F.concat(F.lit("store/x/"), F.when(k % 2 == 0, "arc-").otherwise("old-"), k.cast("string")), "arc-").alias("is_archive"),
    )


@query("""SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders""")
def newest_first(spark, sf_dir):
    """The list in order, with each row's place in it."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    first = tables.materialise(catalog.newest_first(o, "o_orderdate", "o_orderkey").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "newest")
    return tables.numbered(first.select("o_orderkey", "o_orderdate", "part", "at"), ["part", "at"], "n").select("o_orderkey", "o_orderdate", (F.col("n") + 1).alias("place"))


@query("""SELECT o_orderkey, sha256(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus)::VARCHAR) AS evidence_hash, o_orderkey % 4 <> 0 AS seal_ok FROM orders""")
def evidence_seals(spark, sf_dir):
    """Sealed rows of which every fourth was changed afterwards."""
    o = digests.seal(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return digests.sealed_ok(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "?").otherwise(F.col("o_orderstatus")))).select("o_orderkey", "evidence_hash", "seal_ok")


@query(f"WITH {_OBJECTS}, {_BLOCKS}, b AS (SELECT sha256(data) AS h, octet_length(data) AS n FROM blocks), l AS (SELECT CAST(sum(octet_length(encode(props)) + 1) AS BIGINT) AS n, count(*) AS lines FROM events), u AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT h, n FROM b))\n"
       "SELECT (SELECT CAST(sum(n) AS BIGINT) FROM b) AS logical_bytes, u.n + l.n AS physical_bytes, greatest(0, (SELECT CAST(sum(n) AS BIGINT) FROM b) - u.n - l.n) AS saved_bytes, lines FROM u, l")
def archive_with_log(spark, sf_dir):
    """An archive that carries a copy of the log."""
    lines = tables.table(spark, sf_dir, "events").select(F.col("props").alias("value"))
    a = objects.export(_docs(spark, sf_dir), tables.shared_dir(spark, "archive"), "a-1", 1, SMALL_BLOCK, lines)
    return a["summary"].select("logical_bytes", "physical_bytes", "saved_bytes").crossJoin(a["log"].agg(F.count("*").alias("lines")))  # one row each


@query(f"""{_BOTH}, x AS (SELECT count(*) FILTER (status <> 'same') = 0 AS same FROM d) SELECT level, app_ok, CASE WHEN level = 'STRUCTURAL' THEN 'PARTIAL' WHEN app_ok IS NULL THEN 'UNKNOWN' WHEN NOT app_ok THEN 'FAILED' WHEN same THEN 'VERIFIED' ELSE 'PARTIAL' END AS outcome
FROM x, (VALUES ('STRUCTURAL', NULL), ('APPLICATION', true), ('APPLICATION', false), ('APPLICATION', NULL)) v(level, app_ok)""")
def verify_application(spark, sf_dir):
    """With an application's own check: passed, failed, or not given."""
    objs = _docs(spark, sf_dir)
    a, c = mf.manifest(objs), mf.manifest(_edited(objs))
    out = None
    for level, ok in (("STRUCTURAL", None), ("APPLICATION", True), ("APPLICATION", False), ("APPLICATION", None)):
        app = F.lit(ok).cast("boolean")
        row = mf.verify(a, c, level, app).select(F.lit(level).alias("level"), app.alias("app_ok"), "outcome")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH RECURSIVE {_OBJECTS}, l AS (SELECT 0 AS level, list(sha256(path || ':' || sha256(text)) ORDER BY path) AS h FROM objects
UNION ALL SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i < len(h) THEN sha256(unhex(h[i]) || unhex(h[i + 1])) ELSE h[i] END) FROM l WHERE len(h) > 1)
SELECT h[1] AS root, (SELECT count(*) FROM objects) AS files, true AS equal FROM l WHERE len(h) = 1""")
def manifest_equal_by_tree(spark, sf_dir):
    m = mf.manifest(_docs(spark, sf_dir))
    return mf.equal(m, m, tree=True).select(F.col("candidate_root").alias("root"), F.col("active_files").alias("files"), "equal")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'd7-' || event_id ELSE props END AS client_op_id FROM events")
def app_records(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    own = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, "")).otherwise(F.col("props"))
    return log_ops.with_op_ids(e.select(F.col("event_id").alias("arrival"), own.alias("client_op_id")), "d7").withColumnRenamed("arrival", "event_id")


@query("""WITH t AS (SELECT 'kv/key-' || lpad(i::VARCHAR, 2, '0') || '.json' AS path, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS hash FROM (SELECT i, '{"id":' || i || ',"value":"v' || i || '"}' AS t FROM range(40) r(i))
UNION ALL SELECT 'note-00.txt', 512, sha256(repeat(chr(0), 512)) UNION ALL SELECT 'data/blob-00.bin', 16384, sha256(repeat(chr(0), 16384)))
SELECT s_suppkey || '/' || path AS path, size, hash FROM t, supplier""")
def fixture_trees(spark, sf_dir):
    """A fixture tree for each supplier."""
    tree = mf.manifest(tables.fixture(spark, "key-value").unionByName(tables.fixture(spark, "generic"))).select("path", "size", "hash")
    owners = tables.table(spark, sf_dir, "supplier").select("s_suppkey")
    return owners.crossJoin(F.broadcast(tree)).select(F.concat_ws("/", "s_suppkey", "path").alias("path"), "size", "hash")  # tree: 42 rows


def _trees(spark: SparkSession, sf_dir: str, depth: int | None = None) -> tuple[hash_tree.HashTree, hash_tree.HashTree]:
    """The tree of the documents, and one that began as the same and took the edits as an update."""
    objs = _docs(spark, sf_dir)
    active, edited = mf.manifest(objs), mf.manifest(_edited(objs))
    a, c = (hash_tree.HashTree(spark, tables.shared_dir(spark, "hash-tree")).build(active, depth) for _ in range(2))
    changes = mf.diff(active, edited).where("status <> 'same'").select("path", F.col("candidate_hash").alias("hash"))
    return a, c.update(changes)


@query(f"{_BOTH} SELECT path, status, active_hash, candidate_hash FROM d WHERE status <> 'same'")
def hash_tree_diff(spark, sf_dir):
    return hash_tree.diff(*_trees(spark, sf_dir)).rows


@query(f"""{_BOTH}, l AS (SELECT substr(sha256(path), 1, 2) AS leaf, sha256(string_agg(path || ':' || hash || chr(10), '' ORDER BY path)) AS h, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT substr(leaf, 1, 1) AS node, sha256(string_agg(leaf || ':' || h || chr(10), '' ORDER BY leaf)) AS h, sum(n) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(node || ':' || h || chr(10), '' ORDER BY node)) AS root, CAST(sum(n) AS BIGINT) AS entries FROM p""")
def hash_tree_root(spark, sf_dir):
    """The updated tree has the root of one built from nothing."""
    return _trees(spark, sf_dir, depth=2)[1].root()


@query(f"""WITH {_OBJECTS}, {_BLOCKS},
a AS (SELECT DISTINCT sha256(data) AS hash, octet_length(data) AS n, path FROM blocks),
old AS (SELECT DISTINCT hash, n FROM a WHERE path < '000000000200' OR path LIKE '%3'), new AS (SELECT DISTINCT hash, n FROM a WHERE path LIKE '%3' OR path LIKE '%4')
SELECT (SELECT count(*) FROM old) AS first_chunks, (SELECT count(*) FROM new WHERE hash NOT IN (SELECT hash FROM old)) AS second_new_chunks,
(SELECT count(*) FROM old WHERE hash NOT IN (SELECT hash FROM new)) AS removed, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM old WHERE hash NOT IN (SELECT hash FROM new)) AS removed_bytes,
(SELECT count(*) FROM new) AS left_chunks, 0::BIGINT AS faults""")
def chunk_store_sweep(spark, sf_dir):
    """Two archives that share objects; the first goes, a sweep frees what only it held, and the second restores whole."""
    objs, path = _docs(spark, sf_dir), F.col("path")
    store = chunk_store.ChunkStore(spark, tables.shared_dir(spark, "chunk-store"), SMALL_BLOCK)
    first = store.export(objs.where((path < "000000000200") | path.endswith("3")), "a-1").select(F.col("new_chunks").alias("first_chunks"))
    second = store.export(objs.where(path.endswith("3") | path.endswith("4")), "a-2").select(F.col("new_chunks").alias("second_new_chunks"))
    store.remove("a-1")
    swept = store.sweep().drop("segments")
    left = store.references().agg(F.count("*").alias("left_chunks"))
    faults = objects.restore(store.archive("a-2")).agg(F.count_if(F.col("error").isNotNull()).alias("faults"))
    return first.crossJoin(second).crossJoin(swept).crossJoin(left).crossJoin(faults)  # one row each


@query("SELECT count(*) > 0 AS any_blocks, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, 0::BIGINT AS differing FROM documents")
def ranged_blocks(spark, sf_dir):
    """The documents as text files, read block by block, against the blocks of the files read whole."""
    folder = tables.shared_dir(spark, "ranged")
    tables.table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(folder)
    found = ranges.blocks(spark, folder, SMALL_BLOCK, span=1 << 20)
    whole = objects.blocks(objects.tree(spark, folder).select("path", "content"), SMALL_BLOCK).select("path", "offset", F.col("hash").alias("_whole"), F.col("length").alias("_length"))
    both = found.join(whole, ["path", "offset"], "full_outer")
    differs = ~(F.col("hash").eqNullSafe(F.col("_whole")) & F.col("length").eqNullSafe(F.col("_length")))
    return both.agg((F.count("*") > 0).alias("any_blocks"), F.sum("length").alias("bytes"), F.count_if(differs).alias("differing"))
