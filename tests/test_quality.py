from datetime import date

import pytest
from pyspark.sql import functions as F
from tapeloom.errors import QualityError
from tapeloom.operators import quality as qa
from tests.conftest import rows


def gate(spark, total, bad):
    df = spark.range(total).select(F.lit("d").alias("day"), (F.col("id") < bad).alias("bad"))
    return qa.anomaly_gate(df, ["day"], F.col("bad")).first()


@pytest.mark.parametrize("total, bad, passed", [
    (10, 0, True), (10, 1, True), (10, 2, False), (1, 1, False), (300, 3, True), (300, 4, False), (5000, 20, True), (5000, 21, False)])
def test_anomaly_gate_threshold(spark, total, bad, passed):
    assert gate(spark, total, bad)["passed"] is passed


def test_gate_exempts_rows_but_reports_them(spark):
    df = spark.range(100).select(F.lit("d").alias("day"), (F.col("id") < 30).alias("bad"), (F.col("id") >= 30).alias("counted"))
    row = qa.anomaly_gate(df, ["day"], F.col("bad"), counted=F.col("counted")).first()
    assert (row["issues"], row["reported"], row["passed"]) == (0, 30, True)


def lag(spark, n, same, unchanged=0):
    """n comparable rows, ``same`` of which repeat the previous close; ``unchanged`` did not move."""
    data = [(1.0 + (0 if i < unchanged else 1), 1.0, 1.0 if i < same else 2.5) for i in range(n)]
    df = spark.createDataFrame(data, "close double, pre double, other double").withColumn("day", F.lit("d"))
    return qa.segment_lag(df, ["day"], F.lit(True), close="close", pre_close="pre", other_close="other").first()["lagging"]


@pytest.mark.parametrize("n, same, unchanged, lagging", [
    (19, 19, 0, False), (20, 20, 0, True), (20, 20, 1, False), (40, 38, 0, True), (40, 37, 0, False), (25, 25, 5, True)])
def test_segment_lag(spark, n, same, unchanged, lagging):
    assert lag(spark, n, same, unchanged) is lagging


def test_natural_key_and_domains(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (" ", 2), (None, 3), ("b", 4)], "k string, m int")
    assert rows(qa.natural_key_violations(df, ["k", "m"]), "k", "problem") == [(" ", "blank"), ("a", "duplicate"), (None, "blank")]
    bad = qa.outside_domain(df, {"k": ["a", "b"], "m": [1, 4]})
    assert rows(bad, "m", "bad_column") == [(2, "k"), (3, "k")]


def test_calendar(spark):
    full = spark.sql("SELECT 'SSE' exchange, explode(sequence(date'2024-01-01', date'2024-12-31')) cal_date")
    part = full.where("cal_date < date'2024-12-31'").withColumn("exchange", F.lit("SZSE"))
    got = rows(qa.calendar_completeness(full.union(part)), "exchange", "expected", "complete")
    assert got == [("SSE", 366, True), ("SZSE", 366, False)]
    assert rows(qa.missing_exchanges(full, ["SSE", "SZSE"])) == [("SZSE",)]


def test_empty_scope_outcomes(spark):
    grid = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 4, 1)), ("c", date(2024, 4, 1))], "scope string, day date")
    counts = spark.createDataFrame([("c", 5)], "scope string, n long")
    out = qa.classify_empty(grid, counts, ["scope"], policy=F.lit("RETRY"), day="day", today=F.lit("2024-04-20").cast("date"),
                            retention_months=F.lit(3), exhausted=F.lit(False))
    assert rows(out, "scope", "outcome") == [("a", "GAP"), ("b", "RETRY"), ("c", "DATA")]


def test_enforce_reads_the_verdict(spark):
    df = spark.createDataFrame([(True,), (False,)], "ok boolean")
    qa.enforce(df.where("ok"), "fine", verdict="ok")
    with pytest.raises(QualityError):
        qa.enforce(df, "bad", verdict="ok")
    with pytest.raises(QualityError):
        qa.enforce_any(df.where("false"), "empty")
