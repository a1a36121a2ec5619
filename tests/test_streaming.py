from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tapeloom.operators.publish import VersionedTable
from tapeloom.streaming import jobs
from tests.conftest import rows

SCHEMA = "code string, day string, v int, rev int, at timestamp"
T0 = datetime(2024, 1, 1, 9)


def land(spark, path, *data):
    spark.createDataFrame([(c, d, v, r, T0 + timedelta(minutes=m)) for c, d, v, r, m in data], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def schema_of(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_publish_stream_replays_and_late_rows(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    table = VersionedTable(spark, str(tmp_path / "out"), "daily")

    def run():
        stream = jobs.landing(spark, src, schema_of(spark))
        job = jobs.publish_stream(stream, table, lambda b: b.where("v > 0"), F.col("day"), ckpt, keys=["code", "day"], revision="rev")
        job.awaitTermination()

    land(spark, src, ("a", "d1", 1, 1, 0), ("a", "d1", 2, 2, 1), ("b", "d2", 5, 1, 2))
    run()
    assert rows(table.read(), "code", "day", "v") == [("a", "d1", 2), ("b", "d2", 5)]
    run()  # nothing new
    land(spark, src, ("a", "d1", 9, 3, 3))
    run()
    assert rows(table.read(), "code", "day", "v") == [("a", "d1", 9), ("b", "d2", 5)]


def test_a_scope_over_many_batches_keeps_all_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    landed = [[("a", "d1", 1, 1, 0), ("b", "d1", 1, 1, 0), ("x", "d2", 1, 1, 0)], [("c", "d1", 3, 1, 5), ("a", "d1", 2, 2, 5)], [("b", "d1", 9, 0, 6), ("y", "d3", 1, 1, 6)]]
    for part in landed:
        land(spark, src, *part)
    table = VersionedTable(spark, str(tmp_path / "out"), "daily")
    stream = jobs.landing(spark, src, schema_of(spark), files_per_batch=1)
    jobs.publish_stream(stream, table, lambda b: b, F.col("day"), str(tmp_path / "ck"), keys=["code", "day"], revision="rev").awaitTermination()
    want = rows(jobs.newest_revision(spark.read.parquet(src), ["code", "day"], "rev"), "code", "day", "v")
    assert rows(table.read(), "code", "day", "v") == want == [("a", "d1", 2), ("b", "d1", 1), ("c", "d1", 3), ("x", "d2", 1), ("y", "d3", 1)]
    versions = {r["scope_key"]: r["version"].split(".")[0] for r in table.releases().collect()}
    assert versions == {"d1": f"{2:012d}", "d2": f"{0:012d}", "d3": f"{2:012d}"}  # untouched scopes keep their version
    handler = jobs.merge_into(table, F.col("day"), lambda r: jobs.newest_revision(r, ["code", "day"], "rev"))
    replay = spark.createDataFrame([(c, d, v, r, T0 + timedelta(minutes=m)) for c, d, v, r, m in landed[2]], SCHEMA)
    handler(replay, 2)
    assert rows(table.read(), "code", "day", "v") == want


def drain(df, name, mode="append"):
    job = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    job.awaitTermination()
    return df.sparkSession.table(name)


def test_first_delivery_drops_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, ("a", "d", 1, 1, 0), ("b", "d", 1, 1, 1))
    land(spark, src, ("a", "d", 1, 1, 2))
    stream = jobs.landing(spark, src, schema_of(spark), files_per_batch=1)
    out = drain(jobs.first_delivery(stream, ["code", "day"], "at", "1 hour"), "dedup_out")
    assert rows(out, "code") == [("a",), ("b",)]


def test_quota_stream_equals_the_batch_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, *[("a", "d", 1, 1, m) for m in (0, 1, 9, 11, 25)])
    shape = lambda df: df.select(F.col("code").alias("endpoint"), F.col("at").alias("requested_at"), F.col("v").alias("wait_ms"), F.lit("SUCCESS").alias("status"))
    stream = shape(jobs.landing(spark, src, schema_of(spark)))
    out = drain(jobs.quota_stream(stream, "10 minutes", "0 seconds"), "quota_out", "complete")
    batch = jobs.quota_windows(shape(spark.read.parquet(src)), "10 minutes")
    assert rows(out) == rows(batch) and out.count() == 3


def test_running_latest_complete_snapshot(spark, tmp_path):
    src = str(tmp_path / "in")
    for m, n in ((0, 2), (5, 2), (10, 1), (300, 1)):
        land(spark, src, *[(f"c{i}", "d", 1, 1, m) for i in range(n)])
    table = VersionedTable(spark, str(tmp_path / "out"), "hot")
    stream = jobs.landing(spark, src, schema_of(spark), files_per_batch=1)
    sizes = jobs.snapshot_sizes_stream(stream, ["day"], "at", "1 minute")
    job = sizes.writeStream.foreachBatch(jobs.snapshot_state(table, ["day"])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination()
    row = table.read().first()
    assert row["n"] == 2 and row["captured"] == T0 + timedelta(minutes=5)


def test_a_new_checkpoint_keeps_what_is_published(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "out"), "daily")
    for i, data in enumerate(([("a", "d1", 1, 1, 0), ("b", "d1", 1, 1, 0)], [("c", "d1", 3, 1, 5)])):
        src = str(tmp_path / f"in{i}")
        land(spark, src, *data)
        stream = jobs.landing(spark, src, schema_of(spark))
        jobs.publish_stream(stream, table, lambda b: b, F.col("day"), str(tmp_path / f"ck{i}"), keys=["code", "day"], revision="rev").awaitTermination()
    assert rows(table.read(), "code", "v") == [("a", 1), ("b", 1), ("c", 3)]


def test_sums_do_not_double_when_a_batch_is_replayed(spark, tmp_path):
    shape = "endpoint string, requested_at timestamp, wait_ms int, status string"
    table = VersionedTable(spark, str(tmp_path / "out"), "quota")
    handler = jobs.quota_sums(table, "10 minutes")
    batches = [spark.createDataFrame([("e", T0 + timedelta(minutes=m), 0, "SUCCESS") for m in part], shape) for part in ([0, 1], [2, 15], [15])]
    for i in (0, 1, 1, 2, 2):
        handler(batches[i], i)
    assert rows(table.read(), "used") == [(2,), (3,)]


def test_redelivery_long_after_the_first(spark, tmp_path):
    table, bloom = (VersionedTable(spark, str(tmp_path / n), "d", "B") for n in ("out", "bloom"))
    make = lambda *keys: spark.createDataFrame([(k, f"d{k % 3}", T0) for k in keys], "k int, day string, at timestamp")
    for bits in (1 << 10, 64):  # a filter of 64 bits is full soon: all is compared then
        table, bloom = (VersionedTable(spark, str(tmp_path / f"{n}{bits}"), "d", "B") for n in ("out", "bloom"))
        handler = jobs.first_delivery_into(table, bloom, F.col("day"), ["k", "day"], bits=bits)
        for i, batch in enumerate([make(1, 2, 3, 3), make(2, 4), make(*range(40)), make(*range(35, 45))]):
            handler(batch, i)
            handler(batch, i)  # a replay
        assert rows(table.read(), "k") == [(k,) for k in sorted(range(45), key=lambda k: repr((k,)))]


def test_keyed_state_closes_captures_and_survives_a_restart(spark, tmp_path):
    from tapeloom.streaming import captures
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    table = VersionedTable(spark, str(tmp_path / "out"), "hot")
    newest = jobs.merge_into(table, F.col("day"), lambda r: jobs.latest_complete(r, ["day"], "at", "n").select("day", "n", "at"))

    def run():
        with captures.rocksdb_state(spark):
            out = captures.latest_complete_stream(jobs.landing(spark, src, schema_of(spark), files_per_batch=1), ["day"], "at", "3 minutes")
            job = out.writeStream.foreachBatch(newest).outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        job.awaitTermination()
        return {r["day"]: (r["n"], (r["at"] - T0).seconds // 60) for r in table.read().collect()}

    def capture(day, minute, n):
        return [(f"c{i}", day, 1, 1, minute) for i in range(n)]
    land(spark, src, *capture("d1", 0, 2), *capture("d2", 0, 1))
    land(spark, src, *capture("d1", 1, 1))
    assert run() == {"d1": (2, 0), "d2": (1, 0)}
    land(spark, src, *capture("d1", 1, 1), *capture("d1", 5, 1))  # late, but in time: the capture of minute 1 is complete now
    assert run()["d1"] == (2, 1)
    assert run()["d1"] == (2, 1)  # nothing new
    land(spark, src, *capture("d1", 0, 5), *capture("d1", 20, 3))  # minute 0 is closed by now and stays as it was
    got = run()["d1"]
    assert got == (3, 20)
