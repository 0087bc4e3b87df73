import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({name: F.lit(-1) for name in ("block", "key", "component", "spans", "start", "kept", "score", "lines", "print", "words")})

    return make


@pytest.fixture(scope="session")
def small(spark):
    """The smallest test tables."""
    folder = "/root/testdata/sf0.001"
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark", "pages", "labels")}
