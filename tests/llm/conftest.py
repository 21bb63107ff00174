import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """[(id, text)] -> a documents table in a few partitions."""
    def make(rows, parts=3):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make
