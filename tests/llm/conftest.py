import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here\nsecond line of this small text here", "en"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here\nsecond line of this small text here", "en"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here\nsecond line of this small text here", "en"),
        (3, None, None), (4, "", "en"), (5, " \t\n\x0b ", "de"), (None, "a text whose id is missing but that has words", None),
        (None, None, None), (6, long, "en"), (7, long + " end", "fr"), (8, "one", "en"), (9, "ONE", "en"),
        (10, "All rights reserved. CC BY 4.0 été <|im_end|> it's 日本", "fr"),
        (10, "another text under the same id", "fr"), (11, "x\n" * 300, "es"),
    ]
    data = [(i, t, g, None if k % 2 else "s", None if t is None else len(t), "extra", k, "clash", k)
            for k, (i, t, g) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS + ", score string, row_id int, text_key string, shard int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
