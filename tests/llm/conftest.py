import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\r\n\x0b\f ", "en"),
    (5, "one two", "de"),
    (6, "ONE two", "de"),
    (7, "a b c d a b c d a b c d a b c d a b c d a b c d", "en"),
    (8, "nbsp is no space \x1c here \x85 あい \U0001f600\U0001f600 it's I'LL we'll  double   triple\n\n\nlines\r\n", "fr"),
    (9, "same line here\nsame line here\n\n  \nsame line here \nother", "en"),
    (10, "<|endoftext|> before <|endoftext|>after ###*$%&|<>", "en"),
    (11, "word " * 3000 + "x" * 5000, "en"),
    (12, "aaaaaaaaaaa ----------------- ........... 1234567890123   ́́ é", "es"),
    (13, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "en"),
    (13, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "en"),
]


@pytest.fixture
def odd(spark):
    """Documents with null, empty, blank, long, repeated and Unicode texts and clashing extra columns."""
    rows = [(i, t, g, "s0", 7, True, "x") for i, t, g in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean, ids string")


@pytest.fixture
def sample():
    """A slice of the smallest test table: (doc_id, text, lang)."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["lang"].to_pylist(), strict=True))
