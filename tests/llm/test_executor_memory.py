"""Batches of the pipeline's first two stages stay small, and no stage leaves a second pool of them."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from tallyforge.llm import common, packing

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

START = """
import os
import pyarrow as pa
from pyspark.sql import SparkSession
import corpus_pipeline

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
"""

POOLS = START + """
docs = spark.range(0, 50, 1, 1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
corpus_pipeline.pack_sequences(spark, docs, "").count()
found = 0
for pid in filter(str.isdigit, os.listdir("/proc")):
    try:
        parent = open(f"/proc/{pid}/stat").read().rpartition(")")[2].split()[1]
        found += b"pyspark.daemon" in open(f"/proc/{pid}/cmdline", "rb").read() and b"java" in open(f"/proc/{parent}/cmdline", "rb").read() and int(parent) == spark._jvm.java.lang.ProcessHandle.current().pid()
    except OSError:
        pass
print("POOLS", found)
"""


def said(script: str, word: str) -> int:
    run = subprocess.run([sys.executable, "-c", script], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert word in run.stdout, run.stderr[-2000:]
    return int(run.stdout.rpartition(word)[2])


@pytest.mark.parametrize("stage", [0, 1])
def test_rows_of_the_first_stages_reach_python_in_small_batches(spark, stage):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('The cat sat on the mat, ', id) AS text", "'en' AS lang")

    def count(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(b.num_rows for b in batches)]})

    was = spark.conf.get(KEY)
    try:
        for own, rows in (("10000", common.BATCH), ("50", 50)):
            spark.conf.set(KEY, own)
            corpus_pipeline.STAGES[stage][1](spark, docs, "")
            assert docs.mapInArrow(count, "n long").first()[0] == rows  # as for what the stage gave, when the caller writes it
    finally:
        spark.conf.set(KEY, was)


def test_packing_starts_no_second_pool_of_workers():
    assert said(POOLS, "POOLS") == 1


def test_run_puts_the_setting_back(spark, sf_dir):
    was = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "9000")
        corpus_pipeline.run(spark, sf_dir)
        assert spark.conf.get(KEY) == "9000"
    finally:
        spark.conf.set(KEY, was)


def test_small_tables_come_back_as_they_went(spark):
    rows = [(3, 1, 2, 1, 1 << 40, 0), (5, 0, 1, 1, -7, 9)]
    table = common.small_table(spark, rows, packing._SEGMENTS)
    assert table.columns == packing._SEGMENTS.names and [tuple(r) for r in table.collect()] == rows
    none = common.small_table(spark, [], pa.schema([("chain", pa.int32()), ("mask", pa.int64())]))
    assert none.dtypes == [("chain", "int"), ("mask", "bigint")] and none.count() == 0
