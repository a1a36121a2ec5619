"""Alias dedup, merges and snapshot selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom.operators import dedup as dd
from tapeloom.operators.sets import union_tagged
from tapeloom.sources.views import Views

RATE = "decimal(30,10)"


def alias_rows(v: Views):
    """Quotes of retired codes appear twice: under the old code, and every second slot also under the new one."""
    old = v.hot.select("code", "trade_date", "slot", "event_id", "rank")
    fresh = old.join(v.aliases, old.code == v.aliases.old_code).where("slot >= 2").select(
        F.col("new_code").alias("code"), "trade_date", "slot", "event_id", "rank")
    return dd.map_alias(old.unionByName(fresh), v.aliases, "code")


_ALIAS = """
    mapped AS (
      SELECT coalesce(a.new_code, h.code) AS code, h.code AS source_code, trade_date, slot, event_id, rank, a.new_code IS NOT NULL AS is_alias
      FROM (SELECT code, trade_date, slot, event_id, rank FROM v_hot
            UNION ALL SELECT a.new_code, trade_date, slot, event_id, rank FROM v_hot h JOIN v_aliases a ON a.old_code = h.code WHERE slot >= 2) h
      LEFT JOIN v_aliases a ON a.old_code = h.code)"""


@query("dedup_alias", f"""WITH {_ALIAS}
    SELECT code, trade_date, slot, source_code, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY code, trade_date, slot ORDER BY is_alias, event_id) AS rn FROM mapped) WHERE rn = 1""")
def dedup_alias(v: Views):
    out = dd.dedup_alias(alias_rows(v), ["code", "trade_date", "slot"], "event_id")
    return out.select("code", "trade_date", "slot", "source_code", "event_id")


@query("dedup_alias_conflicts", f"""WITH {_ALIAS}
    SELECT code, trade_date, slot, is_alias, count(DISTINCT rank) AS variants FROM mapped GROUP BY ALL HAVING count(DISTINCT rank) > 1""")
def dedup_alias_conflicts(v: Views):
    return dd.alias_conflicts(alias_rows(v), ["code", "trade_date", "slot"], ["rank"])


@query("dedup_alias_replaced", f"""WITH {_ALIAS},
    placed AS (SELECT *, min(event_id) FILTER (WHERE NOT is_alias) OVER (PARTITION BY code, trade_date) AS current FROM mapped)
    SELECT code, trade_date, is_alias, count(DISTINCT rank) + max(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) AS variants FROM placed
    WHERE NOT is_alias OR current IS NULL OR event_id < current GROUP BY ALL
    HAVING count(DISTINCT rank) + max(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) > 1""")
def dedup_alias_replaced(v: Views):
    """Conflicts of a day when the first quote under the new code replaces all that came under the old one."""
    return dd.alias_conflicts(alias_rows(v), ["code", "trade_date"], ["rank"], order="event_id")


@query("dedup_alias_report", f"""WITH {_ALIAS}
    SELECT CAST(sum(n) AS BIGINT) AS rows_read, count(*) AS rows_kept, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
           (SELECT count(DISTINCT source_code) FROM mapped WHERE is_alias) AS codes_mapped
    FROM (SELECT code, trade_date, slot, count(*) AS n FROM mapped GROUP BY ALL)""")
def dedup_alias_report(v: Views):
    return dd.alias_report(alias_rows(v), ["code", "trade_date", "slot"])


@query("dedup_exact", """
    WITH u AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS copies FROM lineitem GROUP BY ALL),
    c AS (SELECT l_orderkey, l_linenumber, count(*) AS variants FROM u GROUP BY ALL HAVING count(*) > 1)
    SELECT 'unique' AS part, l_orderkey, l_linenumber, copies AS n FROM u UNION ALL SELECT 'conflict', l_orderkey, l_linenumber, variants FROM c""")
def dedup_exact(v: Views):
    unique, conflicts = dd.dedup_exact(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"])
    return union_tagged({
        "unique": unique.select("l_orderkey", "l_linenumber", F.col("copies").alias("n")),
        "conflict": conflicts.select("l_orderkey", "l_linenumber", F.col("variants").alias("n"))}, "part")


def merge_input(v: Views):
    """Repeated reports per (code, day): rates near 10, amounts near a million, coarser on some events, some NULL."""
    kind, share = F.col("event_type"), F.col("value") * F.lit("0.00025").cast("decimal(6,5)")
    rate = F.lit(10).cast(RATE) + F.when(kind == "click", F.round(share, 2)).otherwise(F.round(share, 4))
    amount = F.lit(1_000_000).cast(RATE) + F.when(kind == "view", F.round("value", 0)).otherwise(F.col("value"))
    return v.ticks.select(
        "code", "trade_date", "event_id", F.when(kind != "signup", kind).alias("name"),
        F.when(kind != "error", rate.cast(RATE)).alias("rate"), amount.cast(RATE).alias("amount"))


MERGE = dd.MergeRules(["code", "trade_date"], "event_id", free=["name"], rate=["rate"], money=["amount"])


def merge_sql(keys: str) -> str:
    """Ordered fold per key as a recursive statement ending in ``folded`` (one row per key)."""
    same = " AND ".join(f"s.{k} = f.{k}" for k in keys.split(", "))
    left = ", ".join(f"f.{k}" for k in keys.split(", "))
    places = "greatest(1, length(rtrim(split_part(CAST({} AS VARCHAR), '.', 2), '0')))"
    finer = {c: f"{places.format('s.' + c)} > {places.format('f.' + c)}" for c in ("rate", "amount")}
    return f"""
    WITH RECURSIVE src AS (
      SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY event_id) AS rn,
             CASE WHEN event_type <> 'signup' THEN event_type END AS name,
             CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN CAST(10 + round(CAST(value AS DECIMAL(12,6)) * 0.00025, 2) AS DECIMAL(18,6))
                  ELSE CAST(10 + round(CAST(value AS DECIMAL(12,6)) * 0.00025, 4) AS DECIMAL(18,6)) END AS rate,
             CASE WHEN event_type = 'view' THEN 1000000 + CAST(round(value, 0) AS DECIMAL(18,6)) ELSE CAST(1000000 + value AS DECIMAL(18,6)) END AS amount
      FROM v_ticks),
    fold AS (
      SELECT {keys}, rn, name, rate, amount, false AS dead, false AS touched FROM src WHERE rn = 1
      UNION ALL
      SELECT {left}, s.rn, coalesce(f.name, s.name),
             CASE WHEN f.rate IS NULL THEN s.rate WHEN s.rate IS NULL THEN f.rate WHEN {finer["rate"]} THEN s.rate ELSE f.rate END,
             CASE WHEN {finer["amount"]} THEN s.amount ELSE f.amount END,
             f.dead OR coalesce(abs(f.rate - s.rate) > 0.01 OR abs(f.rate - s.rate) > greatest(abs(f.rate), abs(s.rate)) * 0.001, false)
                    OR abs(f.amount - s.amount) > 500 OR abs(f.amount - s.amount) > greatest(abs(f.amount), abs(s.amount)) * 0.001,
             f.touched OR f.name IS DISTINCT FROM s.name OR f.rate IS DISTINCT FROM s.rate OR f.amount IS DISTINCT FROM s.amount
      FROM fold f JOIN src s ON {same} AND s.rn = f.rn + 1),
    folded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) AS last FROM fold) WHERE last = 1)"""


@query("dedup_merge", f"""
    {merge_sql("code, trade_date")}
    SELECT code, trade_date, CASE WHEN dead THEN 'quarantined' WHEN touched THEN 'merged' ELSE 'kept' END AS status,
           CASE WHEN NOT dead THEN name END AS name, CAST(CASE WHEN NOT dead THEN rate END AS DOUBLE) AS rate, CAST(CASE WHEN NOT dead THEN amount END AS DOUBLE) AS amount
    FROM folded""")
def dedup_merge(v: Views):
    return dd.merge_compatible(merge_input(v), MERGE).drop("event_id")


@query("dedup_latest_snapshot", """
    WITH z AS (SELECT trade_date, slot, count(*) AS n FROM v_hot GROUP BY ALL),
    m AS (SELECT trade_date, max(n) AS n FROM z GROUP BY ALL), p AS (SELECT trade_date, max(slot) AS slot FROM z JOIN m USING (trade_date, n) GROUP BY ALL)
    SELECT trade_date, slot, event_id, code, rank FROM v_hot SEMI JOIN p USING (trade_date, slot)""")
def dedup_latest_snapshot(v: Views):
    return dd.latest_complete_snapshot(v.hot, ["trade_date"], "slot").select("trade_date", "slot", "event_id", "code", "rank")


@query("dedup_snapshot_sizes", """
    SELECT trade_date, slot, size, max(size) OVER (PARTITION BY trade_date) AS complete_size FROM (SELECT trade_date, slot, count(*) AS size FROM v_hot GROUP BY ALL)""")
def dedup_snapshot_sizes(v: Views):
    return dd.snapshot_sizes(v.hot, ["trade_date"], "slot")


_SEGMENT = """
    linked AS (SELECT trade_date, event_id, code, rank, slot, captured,
        greatest(coalesce(lag(event_id) OVER (PARTITION BY trade_date, code ORDER BY event_id), -1), coalesce(lag(event_id) OVER (PARTITION BY trade_date, rank ORDER BY event_id), -1)) AS prev FROM v_hot),
    links AS (SELECT trade_date, event_id, (SELECT min(b.event_id) FROM linked b WHERE b.trade_date = a.trade_date AND b.prev >= a.event_id) AS nxt FROM linked a),
    starts AS (SELECT trade_date, min(event_id) AS event_id FROM linked GROUP BY trade_date
        UNION ALL SELECT l.trade_date, l.nxt FROM starts s JOIN links l ON l.trade_date = s.trade_date AND l.event_id = s.event_id WHERE l.nxt IS NOT NULL),
    seg AS (SELECT l.*, s.event_id AS segment_start FROM linked l ASOF JOIN starts s ON s.trade_date = l.trade_date AND s.event_id <= l.event_id)"""


@query("dedup_segment", f"WITH RECURSIVE {_SEGMENT} SELECT trade_date, event_id, code, rank, segment_start FROM seg")
def dedup_segment(v: Views):
    """Small chunks on purpose: snapshots cross many chunk borders."""
    out = dd.segment_snapshots(v.hot, ["trade_date"], "event_id", "code", "rank", chunk_rows=64)
    return out.select("trade_date", "event_id", "code", "rank", "segment_start")


@query("dedup_segment_latest", f"""WITH RECURSIVE {_SEGMENT},
    z AS (SELECT trade_date, segment_start, count(*) AS n, max(captured) AS newest FROM seg GROUP BY ALL),
    p AS (SELECT trade_date, segment_start FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, newest DESC, segment_start) AS rn FROM z) WHERE rn = 1)
    SELECT trade_date, event_id, code, rank FROM seg SEMI JOIN p USING (trade_date, segment_start)""")
def dedup_segment_latest(v: Views):
    seg = dd.segment_snapshots(v.hot, ["trade_date"], "event_id", "code", "rank")
    return dd.latest_complete_segment(seg, ["trade_date"], "captured").select("trade_date", "event_id", "code", "rank")
