import hashlib
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tapeloom.errors import SchemaMismatch
from tapeloom.operators import asof as ao
from tapeloom.operators import lineage as ln
from tapeloom.operators import publish as pb
from tapeloom.sources import assets as sa
from tapeloom.sources import footers
from tapeloom.sources.feeds import FEEDS
from tapeloom.sources.grid import panel
from tests.conftest import rows


def frame(spark, *data):
    return spark.createDataFrame(list(data), "k int, d string, v int")


def test_upsert_forms(spark):
    target, stage = frame(spark, (1, "x", 1), (2, "x", 2)), frame(spark, (2, "y", 20), (3, "y", 30))
    assert rows(pb.upsert(target, stage, ["k"])) == [(1, "x", 1), (2, "y", 20), (3, "y", 30)]
    assert rows(pb.upsert(target, stage, ["k"], ["v"])) == [(1, "x", 1), (2, "x", 20), (3, "y", 30)]
    assert rows(pb.upsert(target, stage, ["k"], [])) == [(1, "x", 1), (2, "x", 2), (3, "y", 30)]


def test_patch_sets_null_and_reports_unknown_keys(spark):
    target, stage = frame(spark, (1, "x", 1), (2, "x", 2)), frame(spark, (2, "y", None), (9, "y", 9))
    assert rows(pb.patch_columns(target, stage, ["k"], ["v"])) == [(1, "x", 1), (2, "x", None)]
    assert rows(pb.unpatched(target, stage, ["k"])) == [(9,)]


def test_target_with_more_columns_and_repeated_stage_keys(spark):
    target, stage = frame(spark, (1, "x", 1), (2, "x", 2)), frame(spark, (2, "y", 20), (3, "y", 30))
    wide = target.withColumn("note", F.lit("own"))
    assert rows(pb.upsert(wide, stage, ["k"]), "k", "d", "v", "note") == [(1, "x", 1, "own"), (2, "y", 20, "own"), (3, "y", 30, None)]
    with pytest.raises(Exception, match="repeated"):
        pb.patch_columns(target, stage.unionAll(stage), ["k"], ["v"]).collect()


def test_replace_clears_on_an_empty_stage(spark):
    target = frame(spark, (1, "x", 1), (2, "y", 2), (3, None, 3))
    assert rows(pb.replace_slice(target, target.where("false"), F.col("d") == "x")) == [(2, "y", 2), (3, None, 3)]
    dates = spark.createDataFrame([("y",)], "d string")
    assert rows(pb.replace_dates(target, target.where("false"), dates, "d")) == [(1, "x", 1), (3, None, 3)]


def test_replace_month_touches_only_staged_indices(spark):
    schema = "index_code string, snapshot_date date, w int"
    target = spark.createDataFrame([("A", date(2024, 1, 5), 1), ("A", date(2024, 2, 5), 2), ("B", date(2024, 1, 9), 3)], schema)
    stage = spark.createDataFrame([("A", date(2024, 1, 31), 9)], schema)
    assert rows(pb.replace_month(target, stage, "index_code", "snapshot_date"), "index_code", "w") == [("A", 2), ("A", 9), ("B", 3)]


def test_carry_over_needs_still_prices_and_a_valid_patch(spark):
    schema = "ts_code string, trade_date string, close double, pre_close double, up double"
    old = spark.createDataFrame([("a", "1", 10.0, 9.0, 11.0), ("b", "1", 10.0, 9.0, 11.0), ("c", "2", 10.0, 9.0, 11.0)], schema)
    new = spark.createDataFrame([("a", "1", 10.0005, 9.0, None), ("b", "1", 10.1, 9.0, None), ("c", "2", 10.0, 9.0, None)], schema)
    valid = spark.createDataFrame([("1",)], "trade_date string")
    got = pb.carry_over(new, old, ["ts_code", "trade_date"], ["up"], valid_dates=valid)
    assert rows(got, "ts_code", "up") == [("a", 11.0), ("b", None), ("c", None)]


def test_stale_parents_of_one_source_only(spark):
    parents = spark.createDataFrame([("S", "1", "a", 1), ("S", "1", "b", 2), ("Z", "1", "c", 1), ("Z", "2", "d", 1)], "source string, trade_date string, code string, synced_at int")
    assert rows(pb.drop_stale(parents, "trade_date"), "code") == [("b",), ("d",)]
    assert rows(pb.drop_stale(parents, "trade_date", within=["source"]), "code") == [("b",), ("c",), ("d",)]


def test_versioned_table(spark, tmp_path):
    table = pb.VersionedTable(spark, str(tmp_path / "t"), "daily")
    table.publish_scopes(frame(spark, (1, "x", 1), (2, "y", 2)), F.col("d"), "001")
    assert rows(table.read(), "k", "v") == [(1, 1), (2, 2)]
    table.publish(frame(spark, (1, "x", 10)), "x", "002")
    assert rows(table.read(), "k", "v") == [(1, 10), (2, 2)]
    table.publish(frame(spark, (1, "x", 0)).where("false"), "x", "003")
    assert rows(table.read(), "k", "v") == [(2, 2)]
    table.publish_scopes(frame(spark, (7, "y", 7)), F.col("d"), "004")
    table.publish_scopes(frame(spark, (7, "y", 7)), F.col("d"), "004")  # a replay changes nothing
    assert rows(table.read(), "k", "v") == [(7, 7)]
    # rows written without a pointer stay invisible
    frame(spark, (9, "x", 9)).write.parquet(f"{table.root}/data/scope_key=x/version=999")
    assert rows(table.read(), "k", "v") == [(7, 7)]


def test_assets_round_trip(spark, tmp_path):
    feed = FEEDS["adj_factor"]
    first = spark.createDataFrame([("a", "20240102", 1.0), ("b", "20240102", 2.0)], feed.schema).coalesce(1)
    second = spark.createDataFrame([("a", "20240103", 3.0)], feed.schema).coalesce(1)
    z, a = str(tmp_path / "z1"), str(tmp_path / "a2")
    sa.seal(first, z)
    sa.seal(second, a)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sa.seal(first, z)
    got = [(r["ts_code"], r["adj_factor"]) for r in sa.read_assets(spark, feed.schema, [z, a]).orderBy("_ord").collect()]
    assert got == [("a", 1.0), ("b", 2.0), ("a", 3.0)]
    with pytest.raises(SchemaMismatch):
        sa.read_assets(spark, FEEDS["stk_limit"].schema, [z])
    paths = [str(tmp_path / n) for n in ("b1", "b2", "b10")]
    for i, p in enumerate(paths):
        sa.seal(spark.createDataFrame([(f"p{i}", "20240102", float(i))], feed.schema).coalesce(1), p)
    for order in (paths, paths[::-1]):
        got = sa.read_assets(spark, feed.schema, order).orderBy("_ord").collect()
        assert [r["ts_code"] for r in got] == [f"p{paths.index(p)}" for p in order]
    turned, short = str(tmp_path / "turned"), str(tmp_path / "short")
    sa.seal(first.select("adj_factor", "ts_code", "trade_date"), turned)
    sa.seal(first.drop("adj_factor"), short)
    with pytest.raises(SchemaMismatch, match="turned.*short"):
        sa.read_assets(spark, feed.schema, [*paths, turned, short])
    empty = str(tmp_path / "empty")
    sa.seal(first.where("false"), empty)
    assert spark.read.parquet(empty).schema.fieldNames() == list(feed.columns)


def test_asset_audit(spark, tmp_path):
    feed = FEEDS["adj_factor"]
    root = str(tmp_path / "store")
    sa.seal(spark.createDataFrame([("a", "20240102", 1.0)], feed.schema).coalesce(1), root)
    stored = sa.asset_inventory(spark, root, feed)
    clean = stored.select("path", "sha256", "row_count")
    assert sa.audit_assets(stored, clean).count() == 0
    forged = clean.withColumn("sha256", F.lit("0")).unionByName(clean.select(F.lit("file:/gone").alias("path"), "sha256", "row_count"))
    assert [r["problem"] for r in sa.audit_assets(stored, forged).orderBy("problem").collect()] == ["hash_mismatch", "missing_file"]
    assert rows(sa.reconcile_assets(stored, forged), "side") == [("missing_file",)]
    mark = sa.schema_fingerprint(feed.schema)
    manifest = spark.createDataFrame([("p", mark), ("q", "other")], "path string, fingerprint string")
    assert rows(sa.foreign_assets(manifest, feed.schema), "path") == [("q",)]


def test_footer_facts(spark, tmp_path):
    """Types as Spark reads them, whoever wrote the file; unreadable files and odd names are facts, not failures."""
    odd = tmp_path / "odd name+%41"
    odd.mkdir()
    at = datetime(2024, 1, 1)
    table = pa.table({"i": pa.array([1, 2], pa.int32()), "t": pa.array([at, at], pa.timestamp("us")), "u": pa.array([at, at], pa.timestamp("us", "UTC")),
                      "d": pa.array([Decimal("1.50"), None], pa.decimal128(9, 2)), "l": pa.array([["a"], []])})
    pq.write_table(table, odd / "plain.parquet")
    pq.write_table(table.select(["t"]), odd / "old.parquet", use_deprecated_int96_timestamps=True)
    pq.write_table(pa.table({"big": pa.array([1], pa.uint64())}), odd / "unsigned.parquet")
    (odd / "torn.parquet").write_bytes(b"PAR1 no footer")
    for name in ("plain", "old"):
        declared = spark.read.parquet(str(odd / f"{name}.parquet")).schema
        facts = sa.schema_drift(spark, declared, [str(odd / f"{name}.parquet")]).collect()[0]
        assert (facts["drifted"], facts["row_count"]) == (False, 2)
    stored = {r["path"].rsplit("/", 1)[1]: r for r in sa.asset_inventory(spark, str(odd)).collect()}
    assert {n: (r["row_count"], r["fits"]) for n, r in stored.items() if n != "unsigned.parquet"} == {
        "plain.parquet": (2, True), "old.parquet": (2, True), "torn.parquet": (None, False)}
    assert all(r["sha256"] == hashlib.sha256((odd / n).read_bytes()).hexdigest() for n, r in stored.items())
    feed = FEEDS["adj_factor"]
    spaced = str(tmp_path / "with space")
    sa.seal(spark.createDataFrame([("a", "20240102", 1.0)], feed.schema).coalesce(1), spaced)
    assert sa.read_assets(spark, feed.schema, [spaced]).count() == 1


def test_digest_reads_a_file_in_pieces(tmp_path, monkeypatch):
    big = tmp_path / "big.parquet"
    pq.write_table(pa.table({"x": list(range(5_000))}), big)
    monkeypatch.setattr(footers, "PIECE", 1_000)
    facts = footers.facts_of(f"file:{big}", True)
    assert facts["sha256"] == hashlib.sha256(big.read_bytes()).hexdigest() and facts["row_count"] == 5_000


def test_monthly_layout_prunes(spark, tmp_path):
    path = str(tmp_path / "m")
    sa.write_monthly(panel(spark, 5, 60), path)
    df = sa.read_days(spark, path, "2019-02-04", "2019-02-08")
    assert df.count() == 25
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_month" in plan
    assert spark.read.parquet(path).select("trade_month").distinct().count() == 3


def test_asof_join_equals_brute_force(spark):
    base = date(2024, 1, 1)
    left = [(k, base + timedelta(days=d)) for k in ("a", "b") for d in range(0, 200, 7)]
    right = [("a", base + timedelta(days=d), d) for d in (3, 40, 41, 150)]
    df = ao.asof_join(spark.createDataFrame(left, "k string, t date"), spark.createDataFrame(right, "k string, s date, v int"),
                      ["k"], left_time="t", right_time="s", columns=["v"])
    want = []
    for k, t in left:
        best = [v for rk, s, v in right if rk == k and s <= t]
        want.append((k, t, best[-1] if best else None))
    assert rows(df, "k", "t", "v") == sorted(want, key=repr)


def test_asof_join_spreads_a_hot_key(spark):
    """One key holds a third of the rows in one month; any bucket size gives the same answer."""
    start, rng = datetime(2024, 1, 1), random.Random(5)
    spread = lambda n, days: [start + timedelta(seconds=rng.randrange(days * 86_400)) for _ in range(n)]
    left = [("hot", t) for t in spread(600, 20)] + [(f"k{i % 40}", t) for i, t in enumerate(spread(900, 300))]
    left += [("hot", left[0][1])] * 50 + [(None, start), ("hot", None), ("only left", start)]
    right = [("hot", t, i) for i, t in enumerate(spread(300, 20))] + [(f"k{i % 40}", t, i) for i, t in enumerate(spread(500, 300))]
    right += [("hot", right[0][1], 10_000), (None, start, 1), ("hot", None, 2), ("only right", start, 3)]
    want = []
    for k, t in left:
        best = max(((s, v) for rk, s, v in right if k is not None and t is not None and rk == k and s is not None and s <= t), default=(None, None))
        want.append((k, t, *best))
    asks, facts = spark.createDataFrame(left, "k string, t timestamp"), spark.createDataFrame(right, "k string, s timestamp, v int")
    for size in (1, 20, 100_000):
        got = ao.asof_join(asks, facts, ["k"], left_time="t", right_time="s", columns=["v"], bucket_rows=size)
        assert rows(got, "k", "t", "asof_s", "v") == sorted(want, key=repr)
    times = asks.unionByName(facts.select("k", F.col("s").alias("t"))).where("k = 'hot' AND t IS NOT NULL")
    cut = ao.in_buckets(times, ao.bucket_limits(times, ["k"], "t", bucket_rows=20), ["k"], "t")
    sizes = [r["count"] for r in cut.distinct().groupBy("_b").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 40
    none = ao.asof_join(asks.where("false"), facts, ["k"], left_time="t", right_time="s", columns=["v"])
    assert none.count() == 0
    assert ao.asof_join(asks, facts.where("false"), ["k"], left_time="t", right_time="s", columns=["v"]).where("v IS NULL").count() == len(left)


def test_closure_and_stale_lineage(spark):
    edges = spark.createDataFrame([("ep", "a"), ("a", "b"), ("b", "a"), ("x", "y")], "upstream string, downstream string")
    seeds = spark.createDataFrame([("ep",)], "name string")
    assert rows(ln.affected_closure(edges, seeds), "name", "depth") == [("a", 1), ("b", 2), ("ep", 0)]
    log = spark.createDataFrame(
        [("core", "DATE", "d1", "1", 1), ("core", "DATE", "d1", "2", 2), ("limit", "DATE", "d1", "9", 3), ("core", "DATE", "d2", "1", 1), ("limit", "DATE", "d2", "8", 2)],
        "dataset string, scope_type string, scope_key string, version string, published_at int")
    used = spark.createDataFrame([("limit", "d1", "9", "core", "1"), ("limit", "d2", "8", "core", "1")],
                                 "dataset string, scope_key string, version string, upstream string, upstream_version string")
    assert rows(pb.stale_lineage(log, used, dependent="limit", upstream="core"), "scope_key", "stale") == [("d1", True), ("d2", False)]
