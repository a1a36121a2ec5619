"""Coverage, enrichment, membership and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom.operators import asof as ao
from tapeloom.operators import joins as jn
from tapeloom.operators.dedup import map_alias
from tapeloom.operators.sets import distinct_codes, missing_from, one_sided, override_merge, union_tagged
from tapeloom.sources.views import Views

KEY = ["code", "trade_date"]


@query("j_alias_map", """
    SELECT b.code AS source_code, coalesce(a.new_code, b.code) AS code, b.trade_date, a.new_code IS NOT NULL AS is_alias
    FROM v_bars b LEFT JOIN v_aliases a ON a.old_code = b.code""")
def j_alias_map(v: Views):
    return map_alias(v.bars, v.aliases, "code").select("source_code", "code", "trade_date", "is_alias")


@query("j_coverage", """
    SELECT 'missing' AS part, code, trade_date, CAST(NULL AS DOUBLE) AS macd FROM v_bars ANTI JOIN v_tech USING (code, trade_date)
    UNION ALL SELECT 'covered', code, trade_date, CAST(macd AS DOUBLE) FROM v_bars JOIN v_tech USING (code, trade_date)""")
def j_coverage(v: Views):
    return union_tagged({
        "missing": jn.uncovered(v.bars, v.tech, KEY),
        "covered": jn.covered_join(v.bars.select(*KEY), v.tech, KEY, ["macd"])}, "part")


@query("j_tolerant_enrich", """
    SELECT p.code, p.trade_date, CASE WHEN t.code IS NULL THEN 'missing' WHEN abs(p.open - t.source_close) > 0.001 THEN 'close_mismatch' END AS enrich_issue,
           CAST(CASE WHEN abs(p.open - t.source_close) <= 0.001 THEN t.macd END AS DOUBLE) AS macd
    FROM v_px p LEFT JOIN v_tech t ON t.code = p.code AND t.trade_date = p.trade_date""")
def j_tolerant_enrich(v: Views):
    """Opening price against the other source's close, so all three outcomes occur."""
    out = jn.tolerant_enrich(v.px, v.tech, KEY, left_close="open", right_close="source_close", columns=["macd"])
    return out.select(*KEY, "enrich_issue", "macd")


@query("j_extra_keys", "SELECT DISTINCT code, trade_date FROM v_suspend ANTI JOIN v_tech USING (code, trade_date)")
def j_extra_keys(v: Views):
    return jn.extra_keys(v.suspend, v.tech, KEY)


@query("j_optional_enrich", """SELECT code, trade_date, CAST(close AS DOUBLE) AS close, CAST(net_mf_amount AS DOUBLE) AS net_mf_amount
    FROM v_bars LEFT JOIN v_flow USING (code, trade_date)""")
def j_optional_enrich(v: Views):
    return jn.optional_enrich(v.bars.select(*KEY, "close"), v.flow, KEY, ["net_mf_amount"])


@query("j_semi_master", "SELECT code, trade_date, volume FROM v_bars WHERE code IN (SELECT code FROM v_sec WHERE list_status <> 'D')")
def j_semi_master(v: Views):
    return jn.in_master(v.bars, v.sec, {"code": "code"}, exclude=F.col("list_status") == "D").select(*KEY, "volume")


@query("j_reject_report", """
    WITH bad AS (SELECT * FROM v_bars WHERE code NOT IN (SELECT code FROM v_sec WHERE list_status <> 'D'))
    SELECT (SELECT count(*) FROM bad) AS rejected,
           (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT DISTINCT code FROM bad ORDER BY code LIMIT 5)) AS examples""")
def j_reject_report(v: Views):
    bad = jn.not_in_master(v.bars, v.sec, {"code": "code"}, exclude=F.col("list_status") == "D")
    return jn.reject_report(bad, "code")


@query("j_semi_two_sided", """SELECT topic, member, weight FROM v_mem
    WHERE topic IN (SELECT topic FROM v_topics WHERE kind = 'N') AND member IN (SELECT member FROM v_parts WHERE kind <> 'ECONOMY')""")
def j_semi_two_sided(v: Views):
    return jn.in_both_masters(v.mem, v.topics.where("kind = 'N'"), v.parts.where("kind <> 'ECONOMY'"),
                              topic={"topic": "topic"}, member={"member": "member"})


@query("j_consistency", """
    SELECT code, trade_date, CAST(p.pre_close AS DOUBLE) AS left_value, CAST(t.source_close AS DOUBLE) AS right_value
    FROM v_px p JOIN v_tech t USING (code, trade_date) WHERE abs(p.pre_close - t.source_close) > 0.001""")
def j_consistency(v: Views):
    return jn.inconsistent(v.px, v.tech, KEY, "pre_close", "source_close")


@query("j_null_safe", """
    SELECT p.process_id, p.task_name, p.d AS day, r.newest AS newest
    FROM (SELECT process_id, task_name, CASE WHEN task_name = '5-LOW' THEN NULL ELSE business_date END AS d FROM v_proc) p
    JOIN (SELECT task_name, CASE WHEN task_name = '5-LOW' THEN NULL ELSE business_date END AS d2, max(process_id) AS newest FROM v_proc GROUP BY ALL) r
      ON r.task_name = p.task_name AND r.d2 IS NOT DISTINCT FROM p.d""")
def j_null_safe(v: Views):
    """Global scopes (NULL date) match each other."""
    day = F.when(F.col("task_name") != "5-LOW", F.col("business_date"))
    runs = v.proc.select("process_id", "task_name", day.alias("day"))
    newest = v.proc.groupBy(F.col("task_name").alias("name"), day.alias("r_day")).agg(F.max("process_id").alias("newest"))
    return jn.null_safe(runs, newest, {"task_name": "name", "day": "r_day"}).select("process_id", "task_name", "day", "newest")


@query("j_anti_both_ways", """
    SELECT member, 'orphan_file' AS side FROM (SELECT DISTINCT member FROM v_mem) ANTI JOIN (SELECT member FROM v_parts WHERE kind <> 'ECONOMY') USING (member)
    UNION ALL SELECT member, 'missing_file' FROM (SELECT member FROM v_parts WHERE kind <> 'ECONOMY') ANTI JOIN v_mem USING (member)""")
def j_anti_both_ways(v: Views):
    return one_sided(v.mem, v.parts.where("kind <> 'ECONOMY'"), ["member"], left_label="orphan_file", right_label="missing_file")


@query("q_orphans", """
    SELECT source, trade_date, theme, code FROM (SELECT DISTINCT event_type AS source, trade_date, slot AS theme, code FROM v_hot)
    ANTI JOIN (SELECT event_type AS source, trade_date, slot AS theme FROM v_hot GROUP BY ALL HAVING max(score) >= 100) USING (source, trade_date, theme)""")
def q_orphans(v: Views):
    from catalog.market import dated_members, dated_themes
    return jn.orphans(dated_members(v), dated_themes(v), ["source", "trade_date", "theme"]).select("source", "trade_date", "theme", "code")


# ---------------------------------------------------------------- as-of


@query("asof_release", """
    SELECT d.dataset, d.asked, max(r.trade_date) AS resolved
    FROM (SELECT dataset, cal_date AS asked FROM (SELECT DISTINCT cal_date FROM v_cal), (SELECT DISTINCT dataset FROM v_rel)) d
    LEFT JOIN v_rel r ON r.dataset = d.dataset AND r.trade_date <= d.asked GROUP BY ALL""")
def asof_release(v: Views):
    days = v.cal.select(F.col("cal_date").alias("asked")).distinct()
    names = ["click", "view", "purchase", "signup", "error"]
    asked = days.withColumn("dataset", F.explode(F.array(*[F.lit(n) for n in names])))
    return ao.asof_release(asked, v.rel)


@query("asof_snapshot", """
    WITH snap AS (SELECT code, trade_date, slot, count(*) AS n FROM v_hot GROUP BY ALL)
    SELECT code, trade_date, slot, n FROM snap SEMI JOIN (SELECT code, max(trade_date) AS trade_date FROM snap
       WHERE trade_date <= (SELECT max(trade_date) FROM v_rel WHERE dataset = 'view' AND trade_date <= DATE '2024-01-20') GROUP BY code) m USING (code, trade_date)""")
def asof_snapshot(v: Views):
    snap = v.hot.groupBy("code", "trade_date", "slot").agg(F.count("*").alias("n"))
    through = ao.latest_joint(v.rel.where("trade_date <= DATE '2024-01-20'"), ["view"])
    return ao.asof_snapshot(snap, ["code"], "trade_date", through)


@query("asof_asset", """
    WITH assets AS (SELECT 'api' || l_linenumber AS name, l_shipdate AS sealed_at, max(l_orderkey) AS asset_id FROM lineitem
                    WHERE l_returnflag = 'A' GROUP BY ALL),
    asks AS (SELECT batch_id, scheduled_at, 'api' || (1 + (length(batch_type) - 5) // 2) AS name FROM v_bat)
    SELECT k.batch_id, k.name, strftime(k.scheduled_at, '%Y-%m-%d %H:%M:%S') AS scheduled_at,
           strftime(a.sealed_at, '%Y-%m-%d %H:%M:%S') AS asof_sealed_at, a.asset_id
    FROM asks k ASOF LEFT JOIN assets a ON a.name = k.name AND a.sealed_at <= k.scheduled_at""")
def asof_asset(v: Views):
    """Newest complete asset of an endpoint sealed at or before each batch."""
    assets = v.table("lineitem").where("l_returnflag = 'A'").groupBy(
        F.concat(F.lit("api"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_shipdate").alias("sealed_at"),
    ).agg(F.max("l_orderkey").alias("asset_id"))
    number = (F.floor((F.length("batch_type") - 5) / 2) + 1).cast("string")
    asks = v.bat.select("batch_id", "scheduled_at", F.concat(F.lit("api"), number).alias("name"))
    return ao.asof_join(asks, assets, ["name"], left_time="scheduled_at", right_time="sealed_at", columns=["asset_id"])


# ---------------------------------------------------------------- sets


@query("set_override_merge", """
    SELECT scope, origin, rows_ AS n FROM (
      SELECT scope, 'current' AS origin, count(*) AS rows_ FROM v_dep WHERE status = 'READY' GROUP BY scope
      UNION ALL SELECT scope, 'prior', count(*) FROM v_dep WHERE status <> 'READY'
        AND scope NOT IN (SELECT scope FROM v_dep WHERE status = 'READY') GROUP BY scope)""")
def set_override_merge(v: Views):
    current = v.dep.where("status = 'READY'").groupBy("scope").agg(F.lit("current").alias("origin"), F.count("*").alias("n"))
    prior = v.dep.where("status <> 'READY'").groupBy("scope").agg(F.lit("prior").alias("origin"), F.count("*").alias("n"))
    return override_merge(current, prior, ["scope"])


@query("set_union_feeds", """
    SELECT 'CONCEPT' AS board_type, topic AS board, CAST(max(weight) AS DOUBLE) AS price FROM v_mem GROUP BY topic
    UNION ALL SELECT 'INDUSTRY', industry, CAST(max(amount) AS DOUBLE) FROM v_bars JOIN v_sec USING (code) GROUP BY industry""")
def set_union_feeds(v: Views):
    concept = v.mem.groupBy(F.col("topic").alias("board")).agg(F.max("weight").alias("price"))
    industry = v.bars.join(v.sec, "code").groupBy(F.col("industry").alias("board")).agg(F.max("amount").cast("double").alias("price"))
    return union_tagged({"CONCEPT": concept, "INDUSTRY": industry}, "board_type")


@query("set_codes", "SELECT topic AS code FROM v_topics UNION SELECT topic FROM v_mem UNION SELECT member FROM v_mem")
def set_codes(v: Views):
    return distinct_codes(v.topics.select(F.col("topic").alias("code")), v.mem.select(F.col("topic").alias("code")),
                          v.mem.select(F.col("member").alias("code")))


@query("set_missing", "SELECT dataset, trade_date FROM (SELECT DISTINCT dataset, trade_date FROM v_release_log) ANTI JOIN v_rel USING (dataset, trade_date)")
def set_missing(v: Views):
    return missing_from(v.release_log.select("dataset", "trade_date").distinct(), v.rel, ["dataset", "trade_date"])


@query("ops_dependencies", """
    WITH c AS (SELECT process_id, count(*) AS dependency_count, count(*) FILTER (WHERE status = 'READY') AS ready_count,
          count(*) FILTER (WHERE status = 'WAITING') AS waiting_count, count(*) FILTER (WHERE status IN ('MISSING', 'FAILED')) AS blocked_count
          FROM v_dep GROUP BY process_id),
    hit AS (SELECT DISTINCT process_id FROM v_dep WHERE contains(lower(name), 'part=11') OR contains(lower(scope), 'part=11')),
    r AS (SELECT task_name, business_date, max(finished_at) AS newest FROM v_proc WHERE status = 'SUCCESS' GROUP BY ALL)
    SELECT p.process_id, p.task_name, p.status, dependency_count, ready_count, waiting_count, blocked_count
    FROM v_proc p JOIN c USING (process_id) LEFT JOIN r USING (task_name, business_date)
    WHERE (p.process_id IN (SELECT process_id FROM hit) OR contains(lower(p.task_name), 'part=11'))
      AND p.status NOT IN ('SUCCESS', 'SKIPPED', 'CANCELLED') AND ready_count < dependency_count AND NOT coalesce(r.newest > p.queued_at, false)""")
def ops_dependencies(v: Views):
    from catalog.operations import SCOPE, releases_of
    from tapeloom.plans.operations import dependency_list
    out = dependency_list(v.proc, v.dep, releases_of(v), SCOPE, view="attention", text="part=11")
    return out.select("process_id", "task_name", "status", "dependency_count", "ready_count", "waiting_count", "blocked_count")
