import pytest

#: Extra columns whose names the operators use inside.
CLASH = ["digest", "regs", "bucket", "component", "h", "place", "row", "rank", "v", "n", "t", "shard", "lang_pred", "score"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and clashing columns."""
    from pyspark.sql import functions as F

    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 3
    rows = [
        (1, base, "en", "b"), (2, base, None, "a"), (3, base + "again", "en", None), (4, None, None, None), (5, "", "de", "b"), (6, " \t\n ", "de", "a"), (7, "%%% 123 !!", "en", "a"),
        (8, "Der schnelle Hund läuft über die Straße und ist müde", "de", "c"), (9, "word " * 60_000, "en", "b"), (10, "one two", "en", "c"), (11, "one two", "en", "c"),
        (12, "x<|endoftext|>y  z\r\n\x1c“ÀÁ”", "fr", "a"), (12, "x<|endoftext|>y  z\r\n\x1c“ÀÁ”", "fr", "a"), (13, "a" * 5000, "en", "a"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in CLASH})
