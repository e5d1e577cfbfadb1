import os
import sys

import pytest
from pyspark.sql import functions as F, types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import CLASH, sample  # noqa: E402


def frame(spark, rows):
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    return df.select("*", *[F.lit("own").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
