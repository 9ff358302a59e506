import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema=SCHEMA):
        """rows: (doc_id, text) or whole rows."""
        full = [r if len(r) > 2 else (r[0], r[1], "en", "src1", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
