import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture()
def odd_documents(spark):
    """Nulls in every column, empty and wordless texts, repeated rows, a long text, and extra columns with clashing names."""
    long = "word " * 30_000
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (3, "...", "en", "b", 2), (4, long, "fr", "a", 3), (5, "same text of just a few words", "en", "a", 4), (5, "same text of just a few words", "en", "a", 4), (6, "same text of just a few words", "en", None, 5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS id", "2 AS bag", "'x' AS block", "3 AS total", "4 AS score", "5 AS hash", "6 AS words")
