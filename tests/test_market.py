"""Contracts of the market questions that the registered queries do not show."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from tapeloom.errors import QueryError
from tapeloom.operators import asof as ao
from tapeloom.operators.ranking import clamp, page, page_or_total
from tapeloom.plans import market as mk
from tapeloom.plans import operations as ops
from tapeloom.sources.views import Views
from tests.conftest import rows


@pytest.fixture(scope="module")
def v(spark, folder):
    return Views(spark, folder)


def code(call):
    with pytest.raises(QueryError) as err:
        call()
    return err.value.code


def test_error_codes(v):
    assert code(lambda: ao.require_joint(v.rel, ["click", "nothing"])) == "DATA_NOT_READY"
    assert code(lambda: ao.joint_dates(v.rel, [])) == "INVALID_REQUEST"
    assert code(lambda: mk.require_known(v.rel, ["click", "nothing"])) == "UNKNOWN_DATASET"
    assert code(lambda: mk.search_securities({}, "  ")) == "INVALID_REQUEST"
    assert code(lambda: mk.require_topic(v.topics, "no such topic")) == "NOT_FOUND"
    assert code(lambda: mk.require_topic(v.topics, "supplier")) == "AMBIGUOUS_IDENTIFIER"
    assert code(lambda: mk.stock_history(v.px, v.rel, datasets=["click"], start="2024-02-01", end="2024-01-01")) == "INVALID_REQUEST"
    assert code(lambda: mk.stock_history(v.px, v.rel, datasets=["click"], adjustment="half")) == "INVALID_REQUEST"
    assert code(lambda: mk.ranking_order("best")) == "INVALID_REQUEST"
    assert code(lambda: mk.data_status(v.rel, ["x"] * 51)) == "INVALID_REQUEST"


def test_exact_topic_wins_over_fuzzy(v):
    assert mk.require_topic(v.topics, "t1")["topic"] == "T1"
    assert mk.require_topic(v.topics, "supplier#000000001")["topic"] == "T1"


def test_members_are_unknown_for_past_dates(v):
    assert mk.top_members(v.mem, historical=True).count() == 0


def test_one_code_history_is_bounded_and_ordered(v):
    some = v.px.first()["code"]
    df = mk.stock_history(v.px, v.rel, datasets=["click"], code=some.lower(), limit=3)
    got = [r["trade_date"] for r in df.orderBy(F.col("trade_date").desc()).collect()]
    assert len(got) <= 3 and set(r["code"] for r in df.collect()) <= {some}
    newest = v.px.where(F.col("code") == some).join(ao.joint_dates(v.rel, ["click"]), "trade_date").agg(F.max("trade_date")).first()[0]
    assert got[0] == newest


def test_paging_past_the_end_still_knows_the_total(v):
    past, total = page_or_total(v.rel, [F.col("trade_date")], 10_000, 5)
    assert past.count() == 0 and total.first()["total"] == v.rel.count()
    assert code(lambda: page(v.rel, [], -1, 5)) == "INVALID_REQUEST"
    assert (clamp(0, 1, 200), clamp(999, 1, 200)) == (1, 200)


def test_alert_branches_are_built_on_request(spark):
    one = spark.createDataFrame([(1, "t", "m", None, "g"), (2, "t", "n", None, "g")], "id int, task_name string, message string, occurred_at timestamp, group_key string")
    branches = {"acquisition/failure": ("action_required", one), "processing/quality": ("quality", one)}
    only = ops.alerts(branches, category="quality")
    assert rows(only, "source", "category", "alert_count", "id") == [("processing", "quality", 2, 1)]
    assert only.first()["message"].startswith("同类告警共 2 条")
    assert rows(ops.alerts(branches, source="acquisition"), "source") == [("acquisition",)]


def test_trading_days_need_a_complete_calendar(v):
    assert ops.trading_days(v.cal, "ASIA", "2024-01-02", "2024-01-08").count() == 5
    assert ops.trading_days(v.cal, "ASIA", "2023-12-30", "2024-01-08").count() == 0


def test_recovery_needs_a_later_success(spark):
    tasks = spark.createDataFrame(
        [(1, "a", "s", "FAILED", 1), (2, "a", "s", "SUCCESS", 2), (1, "b", "s", "FAILED", 5), (2, "b", "s", "SUCCESS", 4), (1, "c", "s", "FAILED", 1), (3, "c", "s", "PENDING", None)],
        "batch_id int, task_name string, scope_key string, status string, finished_at int")
    batches = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 3, None)], "batch_id int, scheduled_at int, business_date date")
    assert rows(ops.unresolved_collection(tasks, batches), "task_name") == [("b",)]


def test_event_sections(spark):
    day = [date(2024, 1, d) for d in range(1, 6)]
    steps = spark.createDataFrame([("A", day[0], 1, None), ("A", day[1], 2, "n"), ("A", day[2], 3, "n"), ("A", day[2], 3, "n"), ("B", day[3], 4, "n"), (None, day[1], 5, "n")],
                                  "ts_code string, trade_date date, nums int, name string")
    boards = spark.createDataFrame([("A", "z", True), ("A", "y", False), ("A", "x", True), ("B", "x", None)], "ts_code string, topic_name string, is_current boolean")
    log = spark.createDataFrame([("stock_limit_step_daily", d) for d in (*day[:3], day[0])] + [("other", day[3])], "dataset string, trade_date date")
    tables = {"limit_steps": steps, "concepts": boards}
    got = rows(mk.event_sections(tables, log, limit_per_type=2).where("ts_code = 'A'"), "section", "trade_date", "payload")
    text = '{"topic_name":"%s","is_current":true}'
    third = (day[2], '{"name":"n","nums":3}')
    assert got == sorted([("concepts", None, text % "x"), ("concepts", None, text % "z"), ("limit_steps", *third), ("limit_steps", *third)], key=repr)
    everything = mk.event_sections(tables, log, limit_per_type=None)
    assert everything.count() == 4 + 1 + 4  # B's day is not released, the row without a code stays
    assert ("limit_steps", '{"name":null,"nums":1}') in rows(everything, "section", "payload")
    one = mk.event_sections(tables, log, code="a", start="2024-01-02", end="2024-01-02")
    assert rows(one.where("section = 'limit_steps'"), "payload") == [('{"name":"n","nums":2}',)] and one.count() == 4
    assert mk.event_sections({"limit_steps": steps.where("false")}, log).count() == 0
    assert code(lambda: mk.event_sections({"gossip": steps}, log)) == "INVALID_REQUEST"
    plan = mk.event_sections(tables, log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("LeftSemi") == 1


def test_packed_rows_are_dealt_by_size_before_they_are_sorted(spark):
    """One key holds all rows: they are trimmed in as many tasks as their size asks for, none of which sorts them all."""
    rows_of_a = spark.range(0, 40_000, 1, 1).selectExpr("concat('A', id % 1) AS ts_code", "concat('name ', id) AS topic_name", "id % 2 = 0 AS is_current")
    log = spark.createDataFrame([("other", date(2024, 1, 1))], "dataset string, trade_date date")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "50k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        asked = mk.event_sections({"concepts": rows_of_a}, log, limit_per_type=2)
        assert [r["payload"] for r in asked.orderBy("payload").collect()] == ['{"topic_name":"name 0","is_current":true}', '{"topic_name":"name 10","is_current":true}']
        dealt = asked._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= dealt.index("WindowGroupLimit") < dealt.index("RebalancePartitions")
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_constituents_of_the_newest_released_month(spark):
    weights = spark.createDataFrame([("I", date(2024, m, 9), f"c{m}", 1.0) for m in (1, 2, 3)], "index_code string, snapshot_date date, con_code string, weight double")
    stocks = spark.createDataFrame([(f"c{m}", "n") for m in (1, 2, 3)], "ts_code string, name string")
    log = spark.createDataFrame([("market_index_weight", date(2024, 1, 1)), ("market_index_weight", date(2024, 2, 1)), ("other", date(2024, 3, 1))],
                                "dataset string, trade_date date")

    def members(requested):
        return rows(mk.constituents(weights, stocks, releases=log, requested=requested), "con_code")
    assert members(None) == members("2024-02-20") == [("c2",)] and members("2024-01-31") == [("c1",)] and members("2023-12-31") == []
