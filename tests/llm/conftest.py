import pytest

import public_tokenizers


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


#: Texts with what tends to go wrong.
ODD = [None, "", " ", "  a  b", "a\n b \n", "x<|endoftext|>y <|endoftext|> z", "<|startoftext|", "a　 b", "é ́a", "don't 's 'll", "\x1c a \x85 b\t c", "Σας ΣΑΣ", "12 345  67\r\n 8", "日本 語", "a " * 300, "x" * 5000, "one two three four five six " * 40, "one two three four five six " * 40]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with a null id, a repeated row and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), i) for i, t in enumerate(ODD)] + [(None, "no id", "en", None, 5, 0), (3, ODD[3], "en", "s", 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")


@pytest.fixture(scope="session")
def clashing(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit(1) for c in ("fp", "doc", "part", "spans", "score", "words", "target", "bucket", "kept")})
