"""Queries that take whole tables, and the rows that a filter ahead of the operator would lose."""

from __future__ import annotations

import time

import catalog
import pytest
from pyspark.sql import functions as F
from catalog import pipelines, publishing
from tapeloom.plans.cleaning import Prepared
from tapeloom.session import scratch_path
from tapeloom.sources.views import Views
from tapeloom.streaming import jobs as st

catalog.load()


def test_every_order_is_landed_and_read(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    got = catalog.QUERIES["src_union_assets"](spark, folder).agg(F.sum("rows_read"), F.sum("places"), F.count("*")).first()
    assert tuple(got) == (orders.count(), orders.count(), orders.select(F.col("o_orderkey") % 11).distinct().count())


def test_every_bar_and_event_is_published_or_rejected(spark, folder):
    views = Views(spark, folder)
    bars, ticks, q = views.px.count(), views.ticks.count(), lambda name: catalog.QUERIES[name](spark, folder)
    assert q("pub_carry_over").count() == bars
    assert q("pipe_core").count() == bars
    themes = views.ticks.groupBy("trade_date", "event_type").count()
    assert q("pub_stale_parent").join(themes.withColumnRenamed("event_type", "theme"), ["trade_date", "theme"]).where("n <> count").count() == 0
    parts = [q(name).agg(F.sum("limit_times")).first()[0] for name in ("pipe_limit_event", "pipe_limit_event_rejects")]
    assert sum(parts) == ticks and min(parts) > 0
    assert q("pipe_optional_factor_rejects").count() == views.px.where("pre_close IS NULL").count() > 0


@pytest.mark.parametrize(("gate", "verified"), [
    ("gate_core_anomalies", "pipe_core"), ("gate_member_conflicts", "pipe_member"), ("gate_calendar_exchange", "pipe_calendar"),
    ("gate_hot_snapshot", "pipe_hot_rank")])
def test_refused_inputs_have_verdicts_and_published_ones_are_verified(spark, folder, monkeypatch, gate, verified):
    assert catalog.QUERIES[gate](spark, folder).count() > 0
    calls = []
    verify = Prepared.verify
    monkeypatch.setattr(Prepared, "verify", lambda self: calls.append(len(self.checks)) or verify(self))
    catalog.QUERIES[verified](spark, folder)
    assert calls and calls[0] > 1


def test_quota_counts_rows_read_long_after_newer_ones(spark, monkeypatch):
    """The newest file is read first, then one 90 days older, then one that shares its windows."""
    def batch(*at):
        return spark.createDataFrame([("e", x, 1, "SUCCESS") for x in at], "endpoint string, at string, wait_ms int, status string").withColumn("requested_at", F.to_timestamp("at"))
    views = Views(spark, "")
    views.__dict__["req"] = batch("2024-06-01 00:01:00")
    path = scratch_path(spark, "late")
    for i, rows in enumerate((batch("2024-06-01 00:01:00"), batch("2024-03-01 00:01:00"), batch("2024-03-01 00:02:00", "2024-06-01 00:09:00"))):
        rows.select("endpoint", "requested_at", "wait_ms", "status").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1)
    schema = spark.read.parquet(path).schema
    monkeypatch.setattr(publishing, "_landed", lambda *_: st.landing(spark, path, schema, files_per_batch=1))
    got = publishing.stream_quota(views).orderBy("window_start").collect()
    assert [(r["used"], r["delayed"], r["success"]) for r in got] == [(2, 2, 2), (2, 2, 2)]


def test_limit_event_at_midnight_keeps_its_time(spark):
    """The feed drops leading zeros of a time; of midnight one zero is left."""
    views = Views(spark, "")
    views.__dict__["ticks"] = spark.sql("SELECT 'U1' AS code, DATE'2024-01-02' AS trade_date, TIMESTAMP_NTZ'2024-01-02 00:00:00.5' AS ts, 'click' AS event_type, 1.0 AS value, 1L AS event_id")
    for status, query in (("L", pipelines.pipe_limit_event), ("D", pipelines.pipe_limit_event_rejects)):
        views.__dict__["sec"] = spark.createDataFrame([("U1", status)], "code string, list_status string")
        assert [(r["first_time"], r["last_time"]) for r in query(views).collect()] == [("00:00:00", "00:00:00")]


def test_bars_on_a_base_of_zero_are_whole(spark):
    """No percent move exists there; the bar is published all the same, and only those without a previous close are refused."""
    views = Views(spark, "")
    views.__dict__["bars"] = spark.sql("""
        SELECT 'U1' AS code, DATE'2024-01-02' + d AS trade_date, p AS open, p AS high, p AS low, p AS close, 1L AS volume, CAST(1 AS DECIMAL(24,4)) AS amount
        FROM VALUES (0, 3.0BD), (1, 0.0BD), (2, 5.0BD) AS t(d, x) LATERAL VIEW explode(array(CAST(x AS DECIMAL(20,6)))) AS p""")
    views.__dict__["flow"] = spark.sql("SELECT 'U1' AS code, DATE'2024-01-04' AS trade_date, 2L AS net_mf_vol")
    views.__dict__["sec"] = spark.createDataFrame([("U1", "L")], "code string, list_status string")
    got = pipelines.pipe_optional_factor(views).orderBy("trade_date").collect()
    assert [(r["trade_date"].day, float(r["close"]), r["adj_factor"]) for r in got] == [(3, 0.0, None), (4, 5.0, 3)]
    assert [(r["trade_date"].day, r["reason"]) for r in pipelines.pipe_optional_factor_rejects(views).collect()] == [(2, "invalid pre_close")]


def test_deliveries_in_files_out_of_order_are_whole(spark, monkeypatch):
    """The newest file is read first: a watermark would drop the two that lie days behind it."""
    views = Views(spark, "")
    views.__dict__["ticks"] = spark.range(9).selectExpr("concat('U', id) AS code", "id AS event_id", "date_add(DATE'2024-01-01', cast(id * 3 AS int)) AS trade_date") \
        .withColumn("ts", F.col("trade_date").cast("timestamp"))

    def landed(v, rows, at):
        path = scratch_path(spark, "backwards")
        for third in (2, 1, 0):
            rows.where(F.floor(F.col("delivery") / 3) == third).coalesce(1).write.mode("append").parquet(path)
            time.sleep(1)
        return st.landing(spark, path, rows.schema, files_per_batch=1)
    monkeypatch.setattr(publishing, "_landed", landed)
    got = publishing.stream_dedup(views)
    assert sorted(r["delivery"] for r in got.collect()) == list(range(9))
