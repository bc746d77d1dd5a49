import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, k long, length long, score double, keep boolean, fp long, shard int"

ODD = [
    "", None, " ", "a", "The cat's sat\n\non  the mat, didn't it?", "x <|endoftext|> y<|startoftext|>z  <|endoftext|>", "ÀÉÎ straße İstanbul ΣΑΣ ΟΔΟΣ", "é café ́x",
    "a b c\u0085d\x1ce\x1ff", "日本語のテキスト 中文 한국어", "👩‍👩‍👧 emoji ✨", "123 4567 8,9 ½ ²", "don't we'll they're I'd I'm you've it's", "tabs\tand\r\nlines \n x", "z" * 5000, ("word " * 3000).strip(), "tail space ", " \n ",
    "The cat sat on the mat again and again until the dog came.", "The cat sat on the mat again and again until the dog came.", "UPPER!! CASE!! TEXT!!",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None, None, "clash", i, 7, 0.5, False, 3, 4) for i, t in enumerate(ODD)]
    rows += [(None, "row without id", "en", *[None] * 9), (3, "a", "en", *[None] * 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
