"""Token counts behind a digest cache.

A cache row maps (tokenizer version, content digest) to a count.  A run joins the
digests of its documents to the cache, encodes one text of each digest that is
missing, appends those counts, and joins the counts back to all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import common

CACHE = "version string, digest string, n_tokens long"

#: A space between two characters that are not white space: byte-level
#: tokenizers begin a token there whatever stands around it.
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, the library and its release."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    library = __import__(name)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{name} {library.__version__}\n".encode() + f.read()).hexdigest()


_COUNTERS: dict = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Per worker: texts -> token counts as the library gives them."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()

            def encode(new: list[str]) -> list[int]:
                return [len(x) for at in range(0, len(new), 1024) for x in tokenizer.encode_batch_fast(new[at : at + 1024], add_special_tokens=False)]

            plain = isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and not tokenizer.pre_tokenizer.add_prefix_space and tokenizer.normalizer is None
            memo = common.SplitMemo(_BETWEEN.split if plain else lambda x: [x], encode)
            _COUNTERS[path] = (lambda texts: [sum(x) for x in memo(texts)]) if plain else encode
    return _COUNTERS[path]


class DigestCache:
    """Counts in a Parquet folder that all executors reach; each append is one atomic write of its own.

    Two runs may append the same digest; readers take one count per digest, and
    both counts are equal as the version names file and library.
    """

    def __init__(self, spark: SparkSession, uri: str | None = None):
        self.spark, self.uri = spark, (uri or common.shared_dir(spark, "token-counts")).rstrip("/")

    def read(self, version: str) -> DataFrame:
        rows = self.spark.read.schema(CACHE).parquet(self.uri) if tables.exists(self.spark, self.uri) else self.spark.createDataFrame([], CACHE)
        return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.uri)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: DigestCache | None = None, limit: int = 512, normalise: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``normalise`` may only change texts in ways that leave the count as it is (the
    default changes nothing, as byte-level tokenizers tell all texts apart).  Null
    text counts as empty, with 0 bytes and tokens; rows with equal or null ids and
    equal rows are kept; extra columns are not read; an empty table gives no rows.
    Each task sends one text a digest at most, however often it holds it, and each
    digest that the cache lacks is encoded once.
    """
    cache = cache or DigestCache(docs.sparkSession)
    version = tokenizer_version(tokenizer_path)
    text = common.text_of(text_col)
    content = normalise(text) if normalise else text
    digest = F.sha2(F.encode(content, "utf-8"), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    rows = common.materialise(rows, "token-digests")
    digests = rows.groupBy("digest").count().select("digest")
    missing = common.materialise(digests.join(cache.read(version), "digest", "left_anti"), "token-missing")
    # Copies fall together in each task before the shuffle; a small ``missing`` is broadcast and filters before that.
    texts = docs.select(digest.alias("digest"), text.alias("t")).groupBy("digest").agg(F.min("t").alias("t")).join(missing, "digest", "left_semi")

    def encode(batches):
        count = counter(tokenizer_path)
        for b in common.rows_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    cache.append(texts.select("digest", "t").mapInArrow(encode, "digest string, n_tokens long").select(F.lit(version).alias("version"), "digest", "n_tokens"))
    # A table of its own, so that AQE can split a digest that very many documents have.
    counts = common.materialise(digests.join(cache.read(version), "digest"), "token-counts-found")
    common.discard(missing)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
