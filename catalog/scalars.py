"""Scalar transforms and the function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom import types as tt
from tapeloom.functions import scalar as sc
from tapeloom.plans import operations as ops
from tapeloom.sources.views import Views


@query("x_text_clean", """
    SELECT doc_id, nullif(trim(replace(concat('  ', chr(12288), lang, chr(9), chr(0), chr(10), ' '), chr(0), ''), concat(' ', chr(9), chr(10), chr(12288))), '') AS lang,
           nullif(trim(CASE WHEN n_chars > 500 THEN concat(' ', chr(10), chr(12288)) ELSE source END, concat(' ', chr(10), chr(12288))), '') AS source,
           md5(trim(replace(text, chr(0), ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), chr(12288)))) AS body
    FROM documents""")
def x_text_clean(v: Views):
    return v.table("documents").select(
        "doc_id", sc.clean_text(F.concat(F.lit("  \u3000"), "lang", F.lit("\t\0\n "))).alias("lang"),
        sc.clean_text(F.when(F.col("n_chars") > 500, " \n\u3000").otherwise(F.col("source"))).alias("source"),
        F.md5(F.coalesce(sc.clean_text("text"), F.lit(""))).alias("body"))


@query("x_date_parse", """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
           o_orderpriority = '5-LOW' AS rejected FROM orders""")
def x_date_parse(v: Views):
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1399"))).otherwise(digits)
    parsed = sc.strict_date(raw)
    return v.table("orders").select("o_orderkey", parsed.alias("d"), sc.unparsable(raw, parsed).alias("rejected"))


@query("x_decimal", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(20,6)) AS DOUBLE) END AS price,
           o_orderstatus = 'P' AS rejected FROM orders""")
def x_decimal(v: Views):
    raw = F.when(F.col("o_orderstatus") == "P", "NaN").otherwise(F.col("o_totalprice").cast("string"))
    parsed = sc.decimal_value(raw, tt.PRICE)
    return v.table("orders").select("o_orderkey", parsed.alias("price"), sc.unparsable(raw, parsed).alias("rejected"))


@query("x_unit_scale", """
    SELECT code, trade_date, CAST(volume * 100 AS DOUBLE) AS shares, CAST(CAST(amount AS DECIMAL(20,4)) * 1000 AS DOUBLE) AS cny,
           CAST(CAST(close AS DECIMAL(20,4)) * 10000 AS DOUBLE) AS cny_wan FROM v_bars""")
def x_unit_scale(v: Views):
    return v.bars.select("code", "trade_date", sc.scaled("volume", 100).alias("shares"), sc.scaled("amount", 1_000).alias("cny"),
                         sc.scaled("close", 10_000).alias("cny_wan"))


@query("x_integer", """
    SELECT event_id, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS whole, value <> floor(value) AS rejected FROM events""")
def x_integer(v: Views):
    whole = sc.exact_integer("value")
    return v.table("events").select("event_id", whole.alias("whole"), sc.unparsable("value", whole).alias("rejected"))


@query("x_flag", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN true ELSE NULL END AS is_open FROM lineitem""")
def x_flag(v: Views):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.flag("l_linenumber").alias("is_open"))


@query("x_clock", "SELECT event_id, strftime(ts, '%H:%M:%S') AS colon, strftime(ts, '%H:%M:%S') AS digits FROM events")
def x_clock(v: Views):
    plain = F.ltrim(F.regexp_replace(F.date_format("ts", "HHmmss"), "^0", ""))
    return v.table("events").select(
        "event_id", sc.clock(F.date_format("ts", "HH:mm:ss")).alias("colon"), sc.clock(plain).alias("digits"))


@query("x_multi_ts", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d') || ' 22:30:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS captured,
           CASE WHEN event_type = 'error' THEN strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '14 hours 30 minutes', '%Y-%m-%d %H:%M:%S')
                ELSE strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc FROM events""")
def x_multi_ts(v: Views):
    spelled = (
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyyMMdd HH:mm:ss"))
        .when(F.col("event_type") == "purchase", F.date_format("ts", "yyyyMMddHHmmss"))
        .when(F.col("event_type") == "signup", F.date_format("ts", "HHmmss"))
    )
    captured = sc.capture_time(spelled, F.to_date("ts"))
    return v.table("events").select("event_id", captured.alias("captured"), sc.to_utc(captured).alias("utc"))


@query("x_json_list", """
    SELECT event_id, CASE event_type WHEN 'click' THEN k || '|' || event_type WHEN 'view' THEN k || '|' || event_type
           WHEN 'purchase' THEN CAST(k AS VARCHAR) WHEN 'signup' THEN '{"k":' || k || '}' END AS items,
           CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 END AS n FROM v_ticks""")
def x_json_list(v: Views):
    k, kind = F.col("k").cast("string"), F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit('["'), k, F.lit('", "'), kind, F.lit('"]')))
        .when(kind == "view", F.concat(F.lit("{"), k, F.lit(" , "), kind, F.lit(",}")))
        .when(kind == "purchase", k)
        .when(kind == "signup", F.concat(F.lit('{"k": '), k, F.lit("}")))
    )
    items = sc.json_list(raw)
    return v.ticks.select("event_id", F.array_join(items, "|").alias("items"), F.when(items.isNotNull(), F.size(items)).alias("n"))


@query("x_scope_kv", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey AS VARCHAR) AS supp, NULL::VARCHAR AS absent FROM lineitem")
def x_scope_kv(v: Views):
    key = F.format_string("line=%d;supp=%d", "l_linenumber", "l_suppkey")
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", sc.scope_param(key, "supp").alias("supp"), sc.scope_param(key, "month").alias("absent"))


@query("x_recode", """SELECT code, exchange AS source_exchange, CASE exchange WHEN 'ASIA' THEN 'SSE' WHEN 'EUROPE' THEN 'SZSE' END AS exchange
    FROM v_sec""")
def x_recode(v: Views):
    return v.sec.select("code", F.col("exchange").alias("source_exchange"),
                        sc.recode("exchange", {"ASIA": "SSE", "EUROPE": "SZSE"}).alias("exchange"))


@query("px_change", """SELECT code, trade_date, CAST(change AS DOUBLE) AS change, CAST(pct_chg AS DOUBLE) AS pct_chg FROM v_px""")
def px_change(v: Views):
    return v.px.select("code", "trade_date", sc.price_change("close", "pre_close").alias("change"),
                       sc.pct_change("close", "pre_close").alias("pct_chg"))


@query("px_correction_flags", """
    SELECT code, trade_date, concat_ws(',', CASE WHEN abs((close - open) - change) > 0.001 THEN 'change' END,
           CASE WHEN abs(CAST(CAST(high - low AS DOUBLE) AS DECIMAL(14,6)) - pct_chg) > 0.01 THEN 'pct_chg' END) AS corrected FROM v_px""")
def px_correction_flags(v: Views):
    flags = sc.correction_flags("close", "pre_close", F.col("close") - F.col("open"), F.col("high") - F.col("low"))
    return v.px.select("code", "trade_date", F.concat_ws(",", flags).alias("corrected"))


@query("x_scope_key", """
    SELECT process_id, CASE WHEN task_name IN ('1-URGENT', '2-HIGH') THEN strftime(business_date, '%Y-%m-%d')
           WHEN task_name = '3-MEDIUM' THEN strftime(business_date, '%Y-%m') ELSE 'GLOBAL' END AS scope_key FROM v_proc""")
def x_scope_key(v: Views):
    return v.proc.select("process_id", sc.scope_key("task_name", "business_date", by_date=("1-URGENT",), by_entity=("2-HIGH",),
                                                    by_month=("3-MEDIUM",)).alias("scope_key"))


@query("x_duration", """
    SELECT process_id, CASE WHEN status = 'FAILED' THEN NULL ELSE
      greatest(0, CAST(epoch_ms(coalesce(finished_at, TIMESTAMP '1998-01-01')) - epoch_ms(queued_at) AS BIGINT)) END AS duration_ms FROM v_proc""")
def x_duration(v: Views):
    """The zone-less times are read as UTC instants, whatever the session zone is."""
    def instant(name):
        return F.concat(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit("Z")).cast("timestamp")

    started = F.when(F.col("status") != "FAILED", instant("queued_at"))
    now = F.lit("1998-01-01 00:00:00Z").cast("timestamp")
    return v.proc.select("process_id", sc.duration_ms(started, instant("finished_at"), now).alias("duration_ms"))


@query("x_status_label", """
    SELECT process_id, CASE status WHEN 'SUCCESS' THEN 'succeeded' WHEN 'FAILED' THEN 'failed' WHEN 'QUEUED' THEN 'pending' END AS label,
           CASE WHEN priority * 250 <= 100 THEN 'current_normal' WHEN priority * 250 <= 200 THEN 'auto_supplement' ELSE 'manual_rerun' END AS level
    FROM v_proc""")
def x_status_label(v: Views):
    scaled = v.proc.withColumn("priority", F.col("priority") * 250)
    return scaled.select("process_id", ops.status_label().alias("label"), ops.priority_label("priority").alias("level"))


# ---------------------------------------------------------------- function surface


@query("fn_math", """
    SELECT event_id, abs(value - 50) AS abs_v, CAST(ceil(value) AS BIGINT) AS ceil_v, CAST(floor(value) AS BIGINT) AS floor_v,
           round(sqrt(value), 6) AS sqrt_v, round(power(value, 2), 4) AS power_v, round(exp(value / 100), 6) AS exp_v,
           CAST(round(CAST(value AS DECIMAL(20,6)), 1) AS DOUBLE) AS round_v,
           greatest(value, 50.0::DOUBLE, NULL) AS greatest_v, least(value, 50.0::DOUBLE, NULL) AS least_v FROM events""")
def fn_math(v: Views):
    x = F.col("value")
    return v.table("events").select(
        "event_id", F.abs(x - 50).alias("abs_v"), F.ceil(x).alias("ceil_v"), F.floor(x).alias("floor_v"),
        F.round(F.sqrt(x), 6).alias("sqrt_v"), F.round(F.power(x, 2), 4).alias("power_v"), F.round(F.exp(x / 100), 6).alias("exp_v"),
        F.round(x.cast(tt.PRICE), 1).alias("round_v"), F.greatest(x, F.lit(50.0), F.lit(None).cast("double")).alias("greatest_v"),
        F.least(x, F.lit(50.0), F.lit(None).cast("double")).alias("least_v"))


@query("fn_string", """
    SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up, length(p_type) AS len,
           concat(p_brand, '/', p_type) AS joined, nullif(p_type, 'ECONOMY') AS not_economy FROM part""")
def fn_string(v: Views):
    return v.table("part").select(
        "p_partkey", F.lower("p_brand").alias("low"), F.upper("p_name").alias("up"), F.char_length("p_type").alias("len"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("not_economy"))


@query("fn_conditional", """
    SELECT code, trade_date, CAST(coalesce(pct_chg, 0) AS DOUBLE) AS pct, CASE WHEN pct_chg IS NULL THEN 'first' WHEN pct_chg > 0 THEN 'up'
           WHEN pct_chg < 0 THEN 'down' ELSE 'flat' END AS direction FROM v_px""")
def fn_conditional(v: Views):
    p = F.col("pct_chg")
    return v.px.select("code", "trade_date", F.coalesce(p, F.lit(0)).alias("pct"), F.when(p.isNull(), "first").when(p > 0, "up").when(
        p < 0, "down").otherwise("flat").alias("direction"))


@query("fn_date", """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
           strftime(o_orderdate, '%Y-%m') AS month_key, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS following FROM orders""")
def fn_date(v: Views):
    return v.table("orders").select(
        "o_orderkey", sc.month_start(F.to_date("o_orderdate")).alias("month"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter"),
        sc.month_key(F.to_date("o_orderdate")).alias("month_key"), sc.next_month(F.to_date("o_orderdate")).alias("following"))


@query("fn_aggregate", """
    SELECT event_type, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high,
           round(CAST(sum(value) AS DOUBLE) / count(*), 6) AS mean, count(DISTINCT code) AS codes FROM v_ticks GROUP BY event_type""")
def fn_aggregate(v: Views):
    return v.ticks.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.sum("value").cast("double") / F.count("*"), 6).alias("mean"), F.count_distinct("code").alias("codes"))
