"""The pipeline's language stage on texts in no learned language."""

import random

import corpus_pipeline
from tallyforge.llm import common

ITALIAN = "La mattina presto il mercato della piazza si riempie di gente che cerca frutta fresca e verdura di stagione mentre i bambini corrono tra le bancarelle"
FINNISH = "Varhain aamulla tori täyttyy ihmisistä jotka etsivät tuoreita hedelmiä ja vihanneksia samalla kun lapset juoksevat kojujen välissä ja vanhat miehet juovat kahvia"


def test_unlearned_languages_go(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    rng = random.Random(1)
    junk = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300))
    texts = [ITALIAN, FINNISH, junk, "Hello world", "The cat sat on the mat and looked out of the window"]
    planted = spark.createDataFrame([(10**7 + i, x, None) for i, x in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(planted), "").collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {10**7 + 3, 10**7 + 4}
