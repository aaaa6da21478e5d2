import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} License, the mit license" for i in range(9_000))
    rows = [
        (1, "The MIT License. the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 5, "x"),
        (2, "The MIT License. the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 5, "x"),
        (2, "The MIT License. the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 5, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "fr", "b", 0, 0, ""),
        (5, long, "en", None, len(long), 7, "y"),
        (6, " \n\t ", "fr", "b", 4, 0, ""),
        (7, "…!? 123 <|endoftext|> </s>", "de", "c", 9, 0, ""),
        (8, "Été à la mer, ὈΔΥΣΣΕΎΣ ſtraße 𝔘𝔫𝔦́ x", "fr", "a", 9, 0, ""),
        (9, "one", "en", "c", 3, 0, ""),
    ]
    return spark.createDataFrame(rows, DOCS)
