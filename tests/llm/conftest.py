import pytest

ODD_COLUMNS = "doc string, n int, token string, pos int, text_ string, _cut int, component_id string, score string"
LONG = " ".join(f"w{i % 977}x{i * i % 1009}" for i in range(40_000))


@pytest.fixture
def odd_docs(spark):
    """Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(1, LONG), (2, LONG), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "a b c d e f g h"),
            (8, "a b c d e f g h"), (9, "A b c D e f g h"), (None, "a b c d e f g h"), (None, None), (10, "x" * 50_000),
            (11, "é漢😀   ü"), (12, "\x00\r\n\n"), (8, "other words of the same id " * 3)]
    extra = ("d", 1, "t", 2, "u", 3, "c", "s")
    return spark.createDataFrame([(*r, "en", "src0", len(r[1] or ""), *extra) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ODD_COLUMNS)
