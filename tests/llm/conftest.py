import pytest


@pytest.fixture
def docs(spark):
    """Makes documents with clashing extra columns from texts or (id, text) pairs."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, symbols string, kept boolean, spans string, ids string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 0.5, "x", True, "y", "z") for i, t in pairs], schema)

    return make


#: Nulls, empty and blank texts, repeated rows, ties, long texts, odd characters.
ODD = [None, "", "  \n\t", "one", "a b c d e", "a b c d e", "é" * 50 + " ß 漢字 🎉", "x" * 50_000, "word " * 3000, "\x1c\x85\xa0 \x00end", "<|endoftext|> hi", (3, "one"), (None, "no id at all here"), (-5, "negative id")]


@pytest.fixture
def odd():
    return list(ODD)
