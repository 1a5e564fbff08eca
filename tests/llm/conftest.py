import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) rows, with columns whose names operators use inside."""

    def make(rows, clash=True):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, ROWS)
        if clash:
            for name in ("_id", "_doc", "_text", "_key", "_in", "_n", "shard", "_row", "_hash", "score"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
