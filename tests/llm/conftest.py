from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def importable(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs(spark):
    """Documents from texts, numbered from 0, or from (doc_id, text) pairs; dealt over three partitions."""
    def make(texts):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame(rows, DOC).repartition(3)
    return make


@pytest.fixture
def clashing(docs):
    """Documents with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def make(texts):
        df = docs(texts)
        for name in ("rid", "row_id", "spans", "n_words", "ids", "key", "features", "label", "held_out", "N_Tokens", "a.b", "words_", "path"):
            df = df.withColumn(name, F.lit(f"own {name}"))
        return df
    return make
