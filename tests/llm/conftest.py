import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    from glucoframe.session import get_spark
    return get_spark(master="local[4]", shuffle_partitions=4, driver_memory="8g")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark: SparkSession):
    def f(texts, ids=None):
        ids = ids or list(range(len(texts)))
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)
    return f
