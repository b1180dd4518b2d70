import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bit string, key string, n string, component_id string, kept string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with extra columns whose names clash with work columns."""

    def make(texts, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), i, "x", "k", "n", "c", "y") for i, t in texts.items()]
        return spark.createDataFrame(rows, SCHEMA)

    return make
