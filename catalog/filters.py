"""Routing, reject splits and text filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom.functions.predicates import not_like_any
from tapeloom.functions.scalar import reject_reason
from tapeloom.operators.quality import split_rejects
from tapeloom.operators.sets import union_tagged
from tapeloom.sources.views import Views


@query("f_route", """
    SELECT 'concept' AS dataset, topic, topic_name FROM v_topics WHERE kind = 'N'
    UNION ALL SELECT 'theme', topic, topic_name FROM v_topics WHERE kind = 'TH'""")
def f_route(v: Views):
    rows = v.topics.select("topic", "topic_name", "kind")
    return union_tagged({"concept": rows.where("kind = 'N'").drop("kind"), "theme": rows.where("kind = 'TH'").drop("kind")}, "dataset")


@query("f_reject_split", """
    SELECT code, trade_date, volume, CASE WHEN pre_close IS NULL THEN 'pre_close missing' WHEN volume < 2 THEN 'thin trading' ELSE 'kept' END AS outcome
    FROM v_px""")
def f_reject_split(v: Views):
    reason = reject_reason((F.col("pre_close").isNull(), "pre_close missing"), (F.col("volume") < 2, "thin trading"))
    kept, rejected = split_rejects(v.px, reason)
    return kept.select("code", "trade_date", "volume", F.lit("kept").alias("outcome")).unionByName(
        rejected.select("code", "trade_date", "volume", F.col("reason").alias("outcome")))


@query("f_warning_suppression", """
    SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND NOT (p_name LIKE '%ring' OR p_name LIKE 'red%' OR p_name LIKE '%dg%')""")
def f_warning_suppression(v: Views):
    return v.table("part").where(not_like_any("p_name", ["%ring", "red%", "%dg%"])).select("p_partkey", "p_name")


@query("q_enum", """
    SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS bad_column
    FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def q_enum(v: Views):
    from tapeloom.operators.quality import outside_domain
    rows = outside_domain(v.table("orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})
    return rows.select("o_orderkey", "bad_column")
