"""Intermediate tables in the cluster's shared folder, and names that clash with nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``store`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a join side that grows with the input: joined by sorting, never broadcast.

    Spark takes a written table for as large as its compressed files; as a broadcast on the driver the rows are tens of times that.
    """
    return df.hint("merge")


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, lengthened until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that have one of the names, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` for any column names (with dots too); ``fn`` takes columns by place."""
    return df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).mapInArrow(fn, schema)


def quoted(name: str) -> str:
    """A column name as one SQL identifier."""
    return "`" + name.replace("`", "``") + "`"
