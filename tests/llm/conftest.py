import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """A documents frame from (doc_id, text) or longer tuples; extra columns with working names of
    the operators show that these clash with nothing."""

    def build(rows, **extra):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def table():
    def rows(name, columns="*", order="1"):
        return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY {order}").fetchall()

    return rows
