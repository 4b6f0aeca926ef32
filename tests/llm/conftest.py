import pytest

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, a null id, and columns whose names clash with inner ones."""
    long_text = " ".join(f"word{k % 977} of line {k}" for k in range(60_000))
    line = "The same rather long line of text that many documents hold."
    rows = [
        (1, None, "en", "src0"),
        (2, "", None, None),
        (3, long_text, "en", "src1"),
        (4, "one two three", "xx", "src0"),
        (4, "one two three", "xx", "src0"),
        (5, "ONE two Three", "de", "src0"),
        (None, line + "\nown line of no id", "en", "src0"),
        *((k, f"{line}\nown line {k}\n  {line.upper()} ", "en", "src2") for k in range(10, 16)),
        (20, "\x1f     é̀ \U0001f600 !!!", "fr", "src3"),
    ]
    rows = [(*r, len(r[1]) if r[1] else None, "a", "b", "c", 7) for r in rows]
    return spark.createDataFrame(rows, DOCS + ", key string, pos string, quality string, `index` long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
