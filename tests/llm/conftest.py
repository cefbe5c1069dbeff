import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Cases that every operator must take: nulls in every column, empty and blank texts, a repeated row, odd characters, a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n\x0b ", None, "s", 5),
    (None, "a null id", "en", "s", 9),
    (None, None, None, None, None),
    (4, "twice the same row", "en", None, 18),
    (4, "twice the same row", "en", None, 18),
    (5, "the same id, another text", "en", "s", 25),
    (5, "with one id 5 again", "en", "s", 19),
    (6, "İΣ é \U0001f600 \x85   \\ \" <|endoftext|> it's \x00", "xx", "s", 1),
    (7, "lang word " * 40_000, "en", "s", 400_000),
]


@pytest.fixture
def odd(spark):
    """The odd rows, with further columns that clash with names the operators use inside."""
    df = spark.createDataFrame(ODD, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("kid", "tk", "fp", "pos", "words", "kept", "n_lines", "component", "held_out", "h", "id", "starts", "text_key", "tile")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
