"""Python workers of the pipeline's last two stages stay small: their batches, the encoder's memory and what they keep for later stages."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import common, queries

PACKS = """
import re
import pyarrow as pa
from pyspark.sql import SparkSession
import corpus_pipeline

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
word = "substr(translate(sha2(concat(id, ' ', i), 256), '0123456789', 'ghijklmnop'), 1, 12)"
docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 55), i -> {word}), ' ') AS text")
corpus_pipeline.pack_sequences(spark, docs, "").count()

def held(batches):
    list(batches)
    kb = re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())
    yield pa.RecordBatch.from_pydict({"mb": [int(kb[0]) // 1024]})

print("HELD", spark.range(0, 1, 1, 1).mapInArrow(held, "mb long").first()[0])
"""


def test_a_worker_gives_back_what_packing_took():
    said = subprocess.run([sys.executable, "-c", PACKS], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert "HELD" in said.stdout, said.stderr[-2000:]
    assert int(said.stdout.rpartition("HELD")[2]) < 125  # 160 with two models and the runs kept, 90 without


def test_batches_are_small_and_the_setting_comes_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)

    def most():
        def count(batches):
            yield pa.RecordBatch.from_pydict({"n": [max(b.num_rows for b in batches)]})

        return common.materialise(spark.range(0, 9000, 1, 1).mapInArrow(count, "n long"), "batches").first()[0]

    try:
        for own, rows in (("10000", common.BATCH), ("0", common.BATCH), ("50", 50)):
            spark.conf.set(key, own)
            with common.small_batches(spark):
                assert most() == rows
            assert spark.conf.get(key) == own
        with pytest.raises(KeyError), common.small_batches(spark):
            raise KeyError
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, was)


def test_the_encoder_remembers_few_runs_and_those_that_come_again():
    library = Tokenizer.from_file(queries.WORD_BPE)
    ids_of = common.WordIds(queries.WORD_BPE, limit=200)
    encoded = []
    plain, single = ids_of._joined, ids_of._single
    ids_of._joined = lambda words: (encoded.extend(words), plain(words))[1]
    ids_of._single = lambda runs: (encoded.extend(runs), single(runs))[1]
    for k in range(60):
        text = " ".join(["again", "Straße,", *(f"w{k}x{i}" for i in range(30))])
        assert [x.tolist() for x in ids_of(pa.array([text]))] == [library.encode(text, add_special_tokens=False).ids]
        assert len(ids_of.known) + len(ids_of.older) <= 200 + 2 * 40
    assert encoded.count(b"again") == 1 and len(encoded) > 1800
    ids_of.forget()
    assert len(ids_of.known) == 1 and not ids_of.older
