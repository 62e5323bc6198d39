import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, n_lines int, kept string, ids string, secret string, host string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    texts = [(1, "the quick brown fox"), (1, "the quick brown fox"), (2, "the quick brown fox"), (3, ""), (4, None), (None, "the quick brown fox"), (None, None), (5, long), (6, long), (7, " \n\t \n"), (8, "12345 678 !!"), (9, "ünïcödé ▁ \U0001f600 x"), (1, "another text of the same id")]
    return spark.createDataFrame([(i, x, "en" if i else None, None, None, 1, 2, "k", "i", "s", "h") for i, x in texts], COLUMNS)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
