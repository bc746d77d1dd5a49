"""Corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage reads the Parquet that the one before wrote.  All but the last return
the columns of ``documents`` and drop whole rows only.  Batches of whole texts are
small throughout: the first two stages, whose Python runs when the caller writes
their rows, set that for the session; ``run`` puts the setting back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common, language, near_copies, packing, quality, queries

#: Texts with no letter, or this far from every learned profile, are no known language.
#: The lowest score of a document of sf0.1 is 0.385; Italian text reaches 0.31.
LEAST_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a learned language; ``lang`` stays as it came."""
    common.keep_batches_small(spark)
    profiles = language.learn(docs.where(~language.held_out("doc_id")))
    found, score = common.fresh(docs, "language", "score")
    judged = language.predict(docs, profiles, keep=tuple(docs.columns), names=(found, score))
    return judged.where((F.col(found) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality scorer does not reject."""
    common.keep_batches_small(spark)
    names = common.fresh(docs, "posterior", "score", "keep")
    judged = quality.classify(docs, quality.fit(docs), keep=tuple(docs.columns), names=names)
    return judged.where(F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies (five-word Jaccard similarity of 0.8: op10's SimHash pairs, verified, and by an exact join those further apart), the document with the smallest id (one row if that id repeats)."""
    return near_copies.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2,048 tokens."""
    return packing.pack_documents(docs, queries.WORD_BPE)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = common.documents(spark, sf_dir), []
    with common.small_batches(spark):
        for name, stage in STAGES[:-1]:
            kept = common.materialise(stage(spark, docs, sf_dir), name)
            common.discard(*done)  # nothing reads the stage before any more
            docs, done = kept, [kept]
        return STAGES[-1][1](spark, docs, sf_dir)
