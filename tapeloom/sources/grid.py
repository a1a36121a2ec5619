"""Expected request scopes, and the seeded panel used for benchmarking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expand(df: DataFrame, **axes: Sequence[object] | Column) -> DataFrame:
    """Multiply each row by fixed parameter lists or array columns.

    A literal list is a bounded request parameter; it is exploded in place, so no join or
    shuffle is involved.
    """
    for name, values in axes.items():
        array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        df = df.withColumn(name, F.explode(array))
    return df


def scope_text(params: Mapping[str, str]) -> Column:
    """``k=v;k=v`` scope key out of (parameter -> column) in the given order."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in params.items()])


def month_axis(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))


def panel(spark: SparkSession, codes: int, days: int, start: str = "2019-01-01") -> DataFrame:
    """Deterministic code x weekday panel with prices, for benchmarks only."""
    span = int(days * 7 / 5) + 7
    last = F.date_add(F.lit(start).cast("date"), span)
    calendar = F.filter(
        F.sequence(F.lit(start).cast("date"), last), lambda d: F.weekday(d) < 5
    )
    base = spark.range(codes).select(
        F.format_string("%06d.SZ", "id").alias("ts_code"), F.col("id").alias("n")
    )
    noise = F.pmod(F.xxhash64("ts_code", "trade_date"), F.lit(1000)) / 100
    return (
        base.withColumn("trade_date", F.explode(F.slice(calendar, 1, days)))
        .withColumn("close", (F.lit(10) + F.pmod("n", F.lit(90)) + noise).cast("decimal(20,6)"))
        .withColumn("pre_close", F.col("close") - F.lit(0.01).cast("decimal(20,6)"))
        .withColumn("volume", F.pmod(F.xxhash64("trade_date", "ts_code"), F.lit(1_000_000)))
        .drop("n")
    )
