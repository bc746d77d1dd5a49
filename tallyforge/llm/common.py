"""Helpers shared by the training-data operators.

Storage rules: whatever must outlive a stage is written below the folder that
``spark.checkpoint.dir`` names, which every executor and the driver can reach.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import discard, hadoop, materialise, shared_dir

__all__ = ["discard", "materialise", "shared_dir"]

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task: Spark deals out the cores


def written_bytes(table: DataFrame) -> int:
    """Bytes of a table that ``materialise`` wrote."""
    fs, at = hadoop(table.sparkSession, table._written)
    return fs.getContentSummary(at).getLength()


#: Compressed bytes of a written table that one task of Python work takes at most.
TASK_BYTES = 32 << 20


def partitions_of(table: DataFrame) -> int:
    """Partitions to deal a written table to: as the session says, and more where it is large."""
    return max(shuffle_partitions(table.sparkSession), -(-written_bytes(table) // TASK_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names made of ``names`` that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a batch under ``small_batches``.
BATCH = 1024
_ROWS_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep_batches_small(spark: SparkSession) -> int:
    """Sets batches of at most ``BATCH`` rows for what the session runs from now on, for tables that the caller writes later; gives what was set."""
    was = int(spark.conf.get(_ROWS_OF_A_BATCH))
    spark.conf.set(_ROWS_OF_A_BATCH, str(min(was, BATCH) if was > 0 else BATCH))
    return was


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile reach Python in batches of at most ``BATCH`` rows: a batch of whole texts lives in the executor and, often twice, in its worker."""
    was = keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(_ROWS_OF_A_BATCH, str(was))


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of the driver's rows, handed over as Arrow: pickled rows pass through Python workers of a second pool, whose daemon then stays in an executor."""
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows, so that Python objects of few texts live at once; after each batch Arrow gives back what it keeps of freed memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
        del batch
        pa.default_memory_pool().release_unused()


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rank_within(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within each value of ``key``, ties in any order.

    A key's c rows are dealt by hash to sqrt(c) buckets, ranked inside a bucket,
    and shifted by the sizes of the buckets before it, so no task sorts more than
    about sqrt(c) rows of one key.  ``key`` must have a bounded number of values
    (its callers: at most 2,048 lengths, 16 shards or 3,072 heavy groups), as the per-key counts are
    broadcast.  ``df`` must be cheap and stable to read twice (a written table).
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_c")).select(F.col(key).alias("_k"), F.ceil(F.sqrt("_c")).cast("long").alias("_nb"))
    salted = df.join(F.broadcast(sizes), F.col(key) == F.col("_k")).withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_nb"))).drop("_k", "_nb")
    before = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_k", "_kb", "_off")
    )
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1)
    return (
        ranked.join(offsets, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")))
        .withColumn(out, F.col("_off") + F.col("_r"))
        .drop("_k", "_kb", "_b", "_off", "_r")
    )


class SplitMemo:
    """Encodes texts piece by piece and remembers what each distinct piece gave.

    Pieces are cut where the tokenizer never joins text, so a text's result is the
    concatenation of its pieces' results.  ``encode`` gets the distinct unseen
    pieces.  The memo holds at most ``limit`` pieces plus those of one batch.
    """

    def __init__(self, split: Callable, encode: Callable[[list], Iterable], limit: int = 400_000):
        self.split, self.encode, self.limit = split, encode, limit
        self.known: dict = {}

    def pieces(self, texts: list) -> list[list]:
        cut = [self.split(x) for x in texts]
        new = set(itertools.filterfalse(self.known.__contains__, itertools.chain.from_iterable(cut)))
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set(itertools.chain.from_iterable(cut))
            new = list(new)
            self.known.update(zip(new, self.encode(new), strict=True))
        return cut

    def __call__(self, texts: list) -> Iterator[Iterator]:
        get = self.known.__getitem__
        for cut in self.pieces(texts):
            yield map(get, cut)


def runs_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Runs between ASCII white space of some texts (null: none): the distinct runs, each run's number, and where each text's runs begin.

    A-Z are lowered first, for tokenizers that lower case; not where a special
    string might stand, as those are told by case.
    """
    texts = texts.take(pa.array(np.arange(len(texts))))  # Arrow's string kernels misread slices of larger arrays
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), (offsets - offsets[0]).astype(np.int64)


def base_and_tail(run: bytes) -> tuple[bytes, bytes]:
    """Cuts plain punctuation off a run that has a Latin letter before it; letters and punctuation never share a token there."""
    if not run or run[-1] >= 97:  # most runs end in a letter or a byte of one
        return run, b""
    base = run.rstrip(b".,;:!?*#$%&")
    if len(base) == len(run) or not base:
        return run, b""
    last = base[-1]
    if 97 <= last <= 122 or 65 <= last <= 90 or (len(base) > 1 and base[-2] == 0xC3 and last not in (0x97, 0xB7)):
        return base, run[len(base) :]
    return run, b""


_WORDS_ONLY = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


class WordIds:
    """Runs of text -> their ids as little-endian unsigned 32-bit integers, by the tokenizers library.

    Plain words are encoded many at a time as one text and cut after each id whose
    token ends a word; all other runs are encoded singly.  At most ``limit`` runs
    and those of one call are remembered, until ``forget``: when half of them are new,
    the older ones go that have not come again.
    """

    def __init__(self, path: str, limit: int = 1 << 16):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same model in memory
        for x in (self.tokenizer, self.plain):
            x.no_truncation()
            x.no_padding()
        # Lower-case Latin words are what the normaliser and the split would leave as they are.
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.suffix_ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.suffix_ends[i] = token.endswith("</w>")
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        """Frees the runs: a worker outlives its tasks, and the stages after this one need the room."""
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _single(self, runs: list[bytes]) -> None:
        for at in range(0, len(runs), 1024):
            some = runs[at : at + 1024]
            for run, x in zip(some, self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in some], add_special_tokens=False), strict=True):
                self.known[run] = array("I", x.ids).tobytes()

    def _joined(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.suffix_ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                self._single(some)
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, cuts, strict=True):
                self.known[word] = data[begin:end]
                begin = end

    def of_runs(self, runs: list[bytes]) -> list[bytes]:
        if 2 * len(self.known) > self.limit:
            self.known, self.older = {b"": b""}, self.known
        cut = [base_and_tail(x) for x in runs]
        words, others = [], []
        for x in {x for pair in cut for x in pair}.difference(self.known):
            if (ids := self.older.get(x)) is not None:
                self.known[x] = ids
                continue
            plain = x.islower() if x.isalpha() else x[0] >= 97 and _WORDS_ONLY(x.decode("utf-8", "replace"))
            (words if plain else others).append(x)
        self._joined(words)
        self._single(others)
        known = self.known
        return [known[base] + known[tail] if tail else known[base] for base, tail in cut]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        runs, numbers, begins = runs_of(texts)
        of = self.of_runs(runs)
        flat = np.frombuffer(b"".join(of), dtype="<u4")
        sizes = np.fromiter(map(len, of), np.int64, len(of)) // 4
        first = np.cumsum(sizes) - sizes
        n = sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(first[numbers] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[begins].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]


_MEMOS: dict = {}


def word_ids(tokenizer_path: str) -> WordIds:
    """Per worker: texts -> ids, for tokenizers that lower case and drop white space.

    ASCII white space always separates tokens there, so the library encodes each
    distinct run between it once.
    """
    if tokenizer_path not in _MEMOS:
        _MEMOS[tokenizer_path] = WordIds(tokenizer_path)
    return _MEMOS[tokenizer_path]
