"""Rollups and scope grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom.operators import aggregates as ag
from tapeloom.operators.asof import joint_dates
from tapeloom.functions.scalar import month_key
from tapeloom.session import scratch_path
from tapeloom.sources import assets as sa
from tapeloom.sources.assets import read_assets, seal
from tapeloom.sources.footers import stored_files
from tapeloom.sources.grid import expand, month_axis, scope_text
from tapeloom.sources.views import Views


@query("agg_joint_release", """SELECT trade_date FROM v_rel WHERE dataset IN ('click', 'view', 'error') GROUP BY trade_date HAVING count(DISTINCT dataset) = 3""")
def agg_joint_release(v: Views):
    return joint_dates(v.rel, ["click", "view", "error", "view"])


@query("agg_latest_joint", """SELECT max(trade_date) AS latest FROM (
    SELECT trade_date FROM v_rel WHERE dataset IN ('click', 'signup') GROUP BY trade_date HAVING count(DISTINCT dataset) = 2)""")
def agg_latest_joint(v: Views):
    return joint_dates(v.rel, ["click", "signup"]).agg(F.max("trade_date").alias("latest"))


@query("agg_conditional", """
    SELECT task_name, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed,
           count(*) FILTER (WHERE status = 'RETRY_WAIT') AS retry, count(*) FILTER (WHERE status IN ('SUCCESS', 'FAILED')) AS terminal
    FROM v_tsk GROUP BY task_name""")
def agg_conditional(v: Views):
    s = F.col("status")
    return ag.conditional_counts(v.tsk, ["task_name"], {
        "success": s == "SUCCESS", "failed": s == "FAILED", "retry": s == "RETRY_WAIT", "terminal": s.isin("SUCCESS", "FAILED")})


@query("agg_group_max", """SELECT process_id, max(blocked_reason) AS max_blocked_reason, max(scope) AS max_scope FROM v_dep GROUP BY process_id""")
def agg_group_max(v: Views):
    return ag.group_max(v.dep, ["process_id"], ["blocked_reason", "scope"])


@query("agg_known_datasets", "SELECT DISTINCT dataset FROM v_rel")
def agg_known_datasets(v: Views):
    return ag.known_datasets(v.rel)


@query("agg_readiness", """
    SELECT process_id, CASE WHEN bool_and(status = 'READY') THEN 'QUEUED' WHEN bool_or(status IN ('MISSING', 'FAILED')) THEN 'BLOCKED' ELSE 'WAITING' END AS readiness
    FROM v_dep GROUP BY process_id""")
def agg_readiness(v: Views):
    return ag.readiness(v.dep, "process_id")


@query("agg_source_summary", """
    SELECT process_id, name, count(*) AS required, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'WAITING') AS waiting,
           count(*) FILTER (WHERE status IN ('MISSING', 'FAILED')) AS blocked, max(blocked_reason) AS blocked_reason FROM v_dep GROUP BY ALL""")
def agg_source_summary(v: Views):
    return ag.source_summary(v.dep, ["process_id", "name"])


@query("agg_batch_complete", """
    WITH a AS (SELECT batch_id, count(*) AS actual, bool_and(status IN ('SUCCESS', 'FAILED')) AS ended FROM v_tsk GROUP BY batch_id)
    SELECT b.batch_id, 3 AS expected, coalesce(actual, 0) AS actual, coalesce(ended, false) AND coalesce(actual, 0) = 3 AS complete
    FROM v_bat b LEFT JOIN a USING (batch_id)""")
def agg_batch_complete(v: Views):
    return ag.batch_completeness(v.bat.withColumn("expected", F.lit(3)), v.tsk, "batch_id", F.col("status").isin("SUCCESS", "FAILED"), "expected")


@query("agg_touched_months", """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS month_end,
           strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month_key, count(*) AS rows FROM orders GROUP BY ALL""")
def agg_touched_months(v: Views):
    return ag.touched_months(v.table("orders").select(F.to_date("o_orderdate").alias("trade_date")))


@query("agg_histogram", "SELECT batch_status, count(*) AS n FROM v_bat GROUP BY batch_status")
def agg_histogram(v: Views):
    return ag.histogram(v.bat, "batch_status")


@query("ops_quota", """
    WITH w AS (SELECT * FROM v_req WHERE requested_at >= (SELECT max(requested_at) FROM v_req) - INTERVAL 86400 SECOND)
    SELECT count(*) AS used, count(*) FILTER (WHERE wait_ms > 0) AS delayed, greatest(0, 400 - count(*)) AS remaining FROM w""")
def ops_quota(v: Views):
    end = v.req.agg(F.max("requested_at")).scalar()
    return ag.trailing_quota(v.req, end, seconds=86_400, budget=400)


@query("scope_grid", """
    SELECT topic, strftime(m, '%Y-%m') AS month, market, 'topic=' || topic || ';month=' || strftime(m, '%Y-%m') || ';market=' || market AS scope_key
    FROM v_topics, (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS m),
         (SELECT unnest(['A', 'B']) AS market)""")
def scope_grid(v: Views):
    span = v.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    months = month_axis(span.select("a").scalar(), span.select("b").scalar())
    grid = expand(v.topics.select("topic"), month=months, market=["A", "B"])
    return grid.withColumn("month", month_key("month")).withColumn("scope_key", scope_text({"topic": "topic", "month": "month", "market": "market"}))


@query("src_union_assets", """
    WITH a AS (SELECT 'a' || coalesce(CAST(o_orderkey % 11 AS VARCHAR), 'none') AS asset, * FROM orders),
    g AS (SELECT asset, count(*) AS rows_read, count(*) AS places, count(DISTINCT o_orderkey) AS keys, count(DISTINCT o_custkey) AS customers, min(o_orderstatus) AS low_status,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS newest, max(o_orderpriority) AS top_priority FROM a GROUP BY asset)
    SELECT *, row_number() OVER (ORDER BY asset DESC) - 1 AS place FROM g""")
def src_union_assets(v: Views):
    """All orders with all columns, landed as assets whose names begin alike (a10, a1, ...) and read in falling order of the names."""
    root = scratch_path(v.spark, "assets")
    orders = v.table("orders")
    name = F.concat(F.lit("a"), F.coalesce((F.col("o_orderkey") % 11).cast("string"), F.lit("none")))
    seal(orders.withColumn("asset", name), root, ("asset",))
    names = sorted((r["asset"] for r in orders.select(name.alias("asset")).distinct().collect()), reverse=True)
    rows = read_assets(v.spark, orders.schema, [f"{root}/asset={n}" for n in names])
    per_asset = rows.groupBy(F.regexp_extract("_asset", "/asset=([^/]*)/[^/]*$", 1).alias("asset")).agg(
        F.min("_ord").alias("first"), F.count("*").alias("rows_read"), F.count_distinct("_ord").alias("places"), F.count_distinct("o_orderkey").alias("keys"),
        F.count_distinct("o_custkey").alias("customers"), F.min("o_orderstatus").alias("low_status"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
        F.max("o_orderdate").alias("newest"), F.max("o_orderpriority").alias("top_priority"))
    in_order = per_asset.groupBy().agg(F.array_sort(F.collect_list(F.struct("first", *[c for c in per_asset.columns if c != "first"]))).alias("assets"))
    return in_order.select(F.posexplode("assets").alias("place", "a")).select("a.*", F.col("place").cast("bigint").alias("place")).drop("first")


@query("src_schema_drift", """
    SELECT 'a' || k AS asset, count(*) AS row_count, k = '3' AS turned, k IN ('1', '2', '3') AS drifted,
           CASE k WHEN '1' THEN 'o_orderdate' ELSE '' END AS missing, CASE k WHEN '1' THEN 'note' ELSE '' END AS extra,
           CASE k WHEN '2' THEN 'o_totalprice' ELSE '' END AS retyped
    FROM (SELECT coalesce(CAST(o_orderkey % 5 AS VARCHAR), 'none') AS k FROM orders) GROUP BY k""")
def src_schema_drift(v: Views):
    """All orders landed as assets, of which one lacks a column and has another, one has a type and one an order of its own."""
    root, orders = scratch_path(v.spark, "drift"), v.table("orders")
    part = F.coalesce((F.col("o_orderkey") % 5).cast("string"), F.lit("none"))
    changed = {
        "1": orders.withColumn("note", F.col("o_orderstatus")).drop("o_orderdate"),
        "2": orders.withColumn("o_totalprice", F.col("o_totalprice").cast("string")),
        "3": orders.select(*reversed(orders.columns)),
        "": orders}
    found = []
    for name, rows in changed.items():
        rows = rows.withColumn("asset", F.concat(F.lit("a"), part))
        seal(rows.where(part == name if name else ~part.isin("1", "2", "3")), f"{root}/form{name}", ("asset",))
        found += stored_files(v.spark.read.parquet(f"{root}/form{name}"))
    facts = sa.schema_drift(v.spark, orders.schema, found)
    listed = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",").alias(c) for c in ("missing", "extra", "retyped")]
    return facts.groupBy(F.regexp_extract("path", "/asset=([^/]*)/[^/]*$", 1).alias("asset")).agg(
        F.sum("row_count").alias("row_count"), F.max("turned").alias("turned"), F.max("drifted").alias("drifted"), *listed)


@query("src_audit", """
    WITH a AS (SELECT coalesce(CAST(o_orderkey % 7 AS VARCHAR), 'none') AS asset, count(*) AS row_count FROM orders GROUP BY ALL)
    SELECT asset, CASE asset WHEN '1' THEN 'orphan_file' WHEN '2' THEN 'hash_mismatch' ELSE 'row_count_mismatch' END AS problem, row_count
    FROM a WHERE asset IN ('1', '2', '3') UNION ALL SELECT asset, 'missing_file', row_count FROM a WHERE asset = '4'""")
def src_audit(v: Views):
    """All orders as stored assets against a manifest made by other means, with one asset forgotten, one forged, one miscounted, one named twice."""
    root = scratch_path(v.spark, "audit")
    seal(v.table("orders").withColumn("asset", F.coalesce((F.col("o_orderkey") % 7).cast("string"), F.lit("none"))), root, ("asset",))
    asset = F.regexp_extract("path", "/asset=([^/]*)/[^/]*$", 1)
    digests = v.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select(
        "path", F.regexp_extract("path", "([^/]*)$", 1).alias("file"), asset.alias("asset"), F.sha2("content", 256).alias("sha256"))
    counted = v.spark.read.parquet(root).groupBy(F.col("_metadata.file_name").alias("file"), F.col("asset").cast("string").alias("asset")).agg(F.count("*").alias("row_count"))
    sealed = digests.join(counted, ["file", "asset"])
    manifest = sealed.where("asset <> '1'").select(
        "path", F.when(F.col("asset") == "2", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("asset") == "3", F.col("row_count") + 1).otherwise(F.col("row_count")).alias("row_count"))
    gone = sealed.where("asset = '4'").select(F.regexp_replace("path", "([^/]*)$", "gone-$1").alias("path"), "sha256", "row_count")
    found = sa.audit_assets(sa.asset_inventory(v.spark, root), manifest.unionByName(gone))
    return found.groupBy(asset.alias("asset"), "problem").agg(F.sum("row_count").alias("row_count"))
