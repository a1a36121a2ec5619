"""Publishing strategies, release log and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from tapeloom import types as tt
from tapeloom.operators import publish as pb
from tapeloom.session import scratch_path
from tapeloom.sources.views import Views
from tapeloom.streaming import captures
from tapeloom.streaming import jobs as st

KEY = ["code", "trade_date"]
WEIGHT_KEYS = ["index_code", "con_code", "snapshot_date"]


@query("pub_upsert", """
    SELECT coalesce(b.code, f.code) AS code, coalesce(b.trade_date, f.trade_date) AS trade_date, b.volume,
           CAST(CASE WHEN f.code IS NOT NULL THEN f.net_mf_amount ELSE b.amount END AS DOUBLE) AS amount, '2024-02-01 00:00:00' AS synced_at
    FROM (SELECT * FROM v_bars WHERE volume >= 2) b FULL JOIN v_flow f ON f.code = b.code AND f.trade_date = b.trade_date""")
def pub_upsert(v: Views):
    target = v.bars.where("volume >= 2").select(*KEY, "volume", "amount")
    stage = v.flow.select(*KEY, F.col("net_mf_amount").alias("amount"))
    return pb.stamp(pb.upsert(target, stage, KEY, ["amount"]), F.lit("2024-02-01").cast("timestamp_ntz"))


@query("pub_insert_only", """
    SELECT code, trade_date, volume AS n FROM v_bars WHERE volume >= 2
    UNION ALL SELECT code, trade_date, net_mf_vol FROM v_flow ANTI JOIN (SELECT * FROM v_bars WHERE volume >= 2) USING (code, trade_date)""")
def pub_insert_only(v: Views):
    target = v.bars.where("volume >= 2").select(*KEY, F.col("volume").alias("n"))
    return pb.upsert(target, v.flow.select(*KEY, F.col("net_mf_vol").alias("n")), KEY, [])


@query("pub_replace_rows", """
    SELECT code, trade_date, net_mf_vol AS n FROM v_flow
    UNION ALL SELECT code, trade_date, volume FROM v_bars ANTI JOIN v_flow USING (code, trade_date)""")
def pub_replace_rows(v: Views):
    target = v.bars.select(*KEY, F.col("volume").alias("n"))
    return pb.upsert(target, v.flow.select(*KEY, F.col("net_mf_vol").alias("n")), KEY)


@query("pub_replace_date", """
    WITH d AS (SELECT DISTINCT trade_date FROM v_rel WHERE dataset = 'view')
    SELECT code, trade_date, volume AS n FROM v_bars WHERE trade_date NOT IN (SELECT trade_date FROM d)
    UNION ALL SELECT code, trade_date, net_mf_vol FROM v_flow WHERE trade_date IN (SELECT trade_date FROM d) AND net_mf_vol > 0""")
def pub_replace_date(v: Views):
    """Every released date is replaced; a date whose stage is empty would be cleared."""
    dates = v.rel.where("dataset = 'view'").select("trade_date").distinct()
    stage = v.flow.where("net_mf_vol > 0").join(dates, "trade_date", "left_semi").select(*KEY, F.col("net_mf_vol").alias("n"))
    return pb.replace_dates(v.bars.select(*KEY, F.col("volume").alias("n")), stage, dates, "trade_date")


@query("pub_replace_entity", """
    SELECT kind AS source, topic, topic_name AS label FROM v_topics WHERE kind <> 'TH'
    UNION ALL SELECT 'TH', member, name FROM v_parts""")
def pub_replace_entity(v: Views):
    target = v.topics.select(F.col("kind").alias("source"), "topic", F.col("topic_name").alias("label"))
    stage = v.parts.select(F.lit("TH").alias("source"), F.col("member").alias("topic"), F.col("name").alias("label"))
    return pb.replace_slice(target, stage, F.col("source") == "TH")


@query("pub_patch", """
    SELECT b.code, b.trade_date, CAST(b.close AS DOUBLE) AS close, CASE WHEN f.code IS NOT NULL THEN f.net_mf_vol ELSE b.volume END AS volume
    FROM v_bars b LEFT JOIN v_flow f ON f.code = b.code AND f.trade_date = b.trade_date""")
def pub_patch(v: Views):
    stage = v.flow.select(*KEY, F.col("net_mf_vol").alias("volume"))
    return pb.patch_columns(v.bars.select(*KEY, "close", "volume"), stage, KEY, ["volume"])


@query("pub_unpatched", "SELECT code, trade_date FROM v_suspend ANTI JOIN v_tech USING (code, trade_date)")
def pub_unpatched(v: Views):
    return pb.unpatched(v.tech, v.suspend, KEY)


def weights(v: Views, flag: str):
    return v.table("lineitem").where(flag).groupBy(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("index_code"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"), F.to_date("l_shipdate").alias("snapshot_date"),
    ).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("weight"))


_W = """SELECT 'T' || l_suppkey AS index_code, 'P' || l_partkey AS con_code, CAST(l_shipdate AS DATE) AS snapshot_date,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM lineitem WHERE {} GROUP BY ALL"""


@query("pub_replace_month", f"""
    WITH t AS ({_W.format("l_returnflag <> 'R'")}), s AS ({_W.format("l_returnflag = 'R'")}),
    m AS (SELECT DISTINCT index_code, date_trunc('month', snapshot_date) AS mon FROM s)
    SELECT t.* FROM t ANTI JOIN m ON m.index_code = t.index_code AND m.mon = date_trunc('month', t.snapshot_date) UNION ALL SELECT * FROM s""")
def pub_replace_month(v: Views):
    return pb.replace_month(weights(v, "l_returnflag <> 'R'"), weights(v, "l_returnflag = 'R'"), "index_code", "snapshot_date")


@query("pub_stale_parent", """
    WITH p AS (SELECT trade_date, event_type AS theme, max(captured) AS synced_at, count(*) AS n FROM v_hot GROUP BY ALL)
    SELECT p.trade_date, theme, strftime(p.synced_at, '%Y-%m-%d %H:%M:%S') AS synced_at, n
    FROM p SEMI JOIN (SELECT trade_date, max(synced_at) AS synced_at FROM p GROUP BY ALL) m USING (trade_date, synced_at)""")
def pub_stale_parent(v: Views):
    """Themes over hot rows of every rank; the sync time is the last capture, so that themes do go stale."""
    parents = v.hot.groupBy("trade_date", F.col("event_type").alias("theme")).agg(F.max("captured").alias("synced_at"), F.count("*").alias("n"))
    return pb.drop_stale(parents, "trade_date")


def carried(v: Views, px: DataFrame):
    fresh = px.select(*KEY, "close", "pre_close")
    moved = (F.col("close") + F.when(F.col("net_mf_vol") > 0, 0).otherwise(1)).cast(tt.PRICE)
    previous = fresh.join(v.flow, KEY).select(*KEY, moved.alias("close"), "pre_close", F.col("net_mf_amount").alias("up_limit"))
    valid = v.rel.where("dataset = 'view'")
    return pb.carry_over(fresh, previous, KEY, ["up_limit"], valid_dates=valid).select(*KEY, "close", "up_limit")


@query("pub_carry_over", """
    SELECT p.code, p.trade_date, CAST(p.close AS DOUBLE) AS close,
           CAST(CASE WHEN p.pre_close IS NOT NULL AND f.net_mf_vol > 0 AND p.trade_date IN (SELECT trade_date FROM v_rel WHERE dataset = 'view') THEN f.net_mf_amount END AS DOUBLE) AS up_limit
    FROM v_px p LEFT JOIN v_flow f ON f.code = p.code AND f.trade_date = p.trade_date""")
def pub_carry_over(v: Views):
    """Rows without a previous close too: they stay, and nothing is carried over to them."""
    return carried(v, v.px)


@query("pub_release_log", """
    SELECT dataset, trade_date, slot, row_count, version FROM (SELECT *, row_number() OVER (PARTITION BY dataset, trade_date ORDER BY published_at DESC, version DESC) AS rn
    FROM v_release_log) WHERE rn = 1""")
def pub_release_log(v: Views):
    return pb.current_releases(v.release_log, ["dataset", "trade_date"]).select("dataset", "trade_date", "slot", "row_count", "version")


@query("lin_stale", """
    WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, trade_date ORDER BY published_at DESC, version DESC) AS rn FROM v_release_log) WHERE rn = 1)
    SELECT strftime(c.trade_date, '%Y-%m-%d') AS scope_key, c.version AS dep_version, u.version AS up_version, l.version AS upstream_version,
           l.version IS DISTINCT FROM u.version AS stale
    FROM cur c JOIN cur u ON u.trade_date = c.trade_date AND u.dataset = 'view'
    LEFT JOIN v_release_log l ON l.trade_date = c.trade_date AND l.dataset = 'view' AND l.slot = c.slot WHERE c.dataset = 'click'""")
def lin_stale(v: Views):
    """Was the current click release computed against the current view release (same slot)?"""
    day = F.date_format("trade_date", "yyyy-MM-dd")
    log = v.release_log.select("dataset", F.lit("DATE").alias("scope_type"), day.alias("scope_key"), "version", "published_at", "slot")
    views = log.where("dataset = 'view'").select("scope_key", "slot", F.col("version").alias("upstream_version"))
    lineage = log.where("dataset = 'click'").join(views, ["scope_key", "slot"]).withColumn("upstream", F.lit("view"))
    return pb.stale_lineage(log, lineage, dependent="click", upstream="view")


# ---------------------------------------------------------------- streams over landed files


def _landed(v: Views, rows, at: str):
    """The rows landed as three files in the order of ``at``, and a stream that reads one file a micro-batch."""
    path = scratch_path(v.spark, "landing")
    rows.repartitionByRange(3, at).write.parquet(path)
    return st.landing(v.spark, path, rows.schema, files_per_batch=1)


@query("stream_publish", "SELECT code, trade_date, arg_max(value, event_id)::DOUBLE AS value, max(event_id) AS revision FROM v_ticks GROUP BY ALL")
def stream_publish(v: Views):
    """Ticks in three micro-batches; most dates arrive in more than one."""
    stream = _landed(v, v.ticks.select(*KEY, "value", F.col("event_id").alias("revision")), "revision")
    table = pb.VersionedTable(v.spark, scratch_path(v.spark, "ticks"), "ticks")
    day = F.date_format(F.col("trade_date").cast("timestamp_ntz"), "yyyy-MM-dd")
    st.publish_stream(stream, table, lambda b: b, day, scratch_path(v.spark, "state"), keys=KEY, revision="revision").awaitTermination()
    return table.read().select(*KEY, "value", "revision")


@query("stream_quota", """
    SELECT endpoint, strftime(time_bucket(INTERVAL 10 MINUTE, requested_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS used,
           count(*) FILTER (WHERE wait_ms > 0) AS delayed, count(*) FILTER (WHERE status = 'SUCCESS') AS success FROM v_req GROUP BY ALL""")
def stream_quota(v: Views):
    """Windows summed over three micro-batches in any order, whatever span of time they cover."""
    requests = v.req.select("endpoint", F.col("requested_at").cast("timestamp").alias("requested_at"), "wait_ms", "status")
    table = pb.VersionedTable(v.spark, scratch_path(v.spark, "quota"), "quota")
    landed = _landed(v, requests, "requested_at")
    job = landed.writeStream.foreachBatch(st.quota_sums(table, "10 minutes")).option("checkpointLocation", scratch_path(v.spark, "state")).trigger(availableNow=True)
    job.start().awaitTermination()
    return table.read().select("endpoint", "window_start", "used", "delayed", "success")


@query("stream_publish_reset", "SELECT code, trade_date, arg_max(value, event_id)::DOUBLE AS value, max(event_id) AS revision FROM v_ticks GROUP BY ALL")
def stream_publish_reset(v: Views):
    """The ticks in two streams with a checkpoint each: batch ids begin again at 0, what the first published stays."""
    ticks = v.ticks.select(*KEY, "value", F.col("event_id").alias("revision"))
    table = pb.VersionedTable(v.spark, scratch_path(v.spark, "ticks"), "ticks")
    day = F.date_format(F.col("trade_date").cast("timestamp_ntz"), "yyyy-MM-dd")
    for half in (0, 1):
        stream = _landed(v, ticks.where(F.pmod(F.xxhash64("revision"), F.lit(2)) == half), "revision")
        st.publish_stream(stream, table, lambda b: b, day, scratch_path(v.spark, "state"), keys=KEY, revision="revision").awaitTermination()
    return table.read().select(*KEY, "value", "revision")


@query("stream_dedup", "SELECT code, event_id AS delivery, trade_date FROM v_ticks")
def stream_dedup(v: Views):
    """Every tick is delivered, then all are delivered again in a second stream; each is published once, in whatever order the files come."""
    rows = v.ticks.select("code", F.col("event_id").alias("delivery"), "trade_date", F.col("ts").cast("timestamp").alias("at"))
    table = pb.VersionedTable(v.spark, scratch_path(v.spark, "deliveries"), "deliveries")
    bloom = pb.VersionedTable(v.spark, scratch_path(v.spark, "bloom"), "deliveries", "BUCKET")
    day, keys = F.date_format(F.col("trade_date").cast("timestamp_ntz"), "yyyy-MM-dd"), ["delivery", "trade_date"]
    for _ in range(2):
        once = st.first_delivery_into(table, bloom, day, keys)
        landed = _landed(v, rows, "at")
        landed.writeStream.foreachBatch(once).option("checkpointLocation", scratch_path(v.spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return table.read().select("code", "delivery", "trade_date")


@query("stream_snapshot", """
    WITH z AS (SELECT trade_date, slot, count(*) AS n FROM v_hot GROUP BY ALL)
    SELECT trade_date, n, slot FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, slot DESC) AS rn FROM z) WHERE rn = 1""")
def stream_snapshot(v: Views):
    """Captures delivered up to six hours late, in time order of delivery; the stream stops after two files and goes on from its checkpoint."""
    slot = F.timestamp_seconds(F.unix_timestamp(F.col("trade_date").cast("timestamp")) + F.col("slot") * 21600)
    rows = v.hot.select("trade_date", slot.alias("at"), (F.unix_timestamp("captured") + F.col("event_id") % 7 * 3600).alias("delivered"))
    path, table = scratch_path(v.spark, "landing"), pb.VersionedTable(v.spark, scratch_path(v.spark, "hot"), "hot")
    bounds = rows.agg(F.percentile_approx("delivered", [0.4, 0.7])).first()[0]
    checkpoint = scratch_path(v.spark, "state")
    third = F.when(F.col("delivered") <= bounds[0], 0).when(F.col("delivered") <= bounds[1], 1).otherwise(2)
    for landing in ([0, 1], [2]):
        for part in landing:
            rows.where(third == part).drop("delivered").coalesce(1).write.mode("append").parquet(path)
        feed = st.landing(v.spark, path, rows.drop("delivered").schema, files_per_batch=1)
        with captures.rocksdb_state(v.spark):
            running = captures.latest_complete_stream(feed, ["trade_date"], "at", "1 day")
            day = F.date_format(F.col("trade_date").cast("timestamp_ntz"), "yyyy-MM-dd")
            newest = st.merge_into(table, day, lambda r: st.latest_complete(r, ["trade_date"], "at", "n").select("trade_date", "n", "at"))
            job = running.writeStream.foreachBatch(newest).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        job.awaitTermination()
    return table.read().select("trade_date", "n", F.floor(F.hour("at") / 6).cast("int").alias("slot"))
