import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (id, text) or (id, text, lang, source); n_chars is null."""

    def make(rows, extra=False):
        rows = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
        df = spark.createDataFrame(rows, DOCUMENT)
        if extra:  # columns that operators use as names of their own
            for name in ("id", "key", "digest", "keep_id", "fp", "u", "v", "size", "target", "ids", "label", "vector", "bytes", "rep"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)

    return make
