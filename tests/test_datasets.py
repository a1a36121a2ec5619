"""The dataset presets on hand-written raw rows."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tapeloom.errors import QualityError
from tapeloom.plans import datasets as ds
from tapeloom.session import written
from tapeloom.sources.feeds import FEEDS
from tests.conftest import rows

D = "20240102"


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Tiny inputs, wide plans: compiling them would take most of the time."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def make(spark):
    def build(feed, *records):
        schema = FEEDS[feed].schema
        data = [tuple(r.get(f.name) for f in schema) + (i,) for i, r in enumerate(records)]
        return spark.createDataFrame(data, schema.add("_ord", "long")).coalesce(1)
    return build


@pytest.fixture
def stock(spark):
    return spark.createDataFrame([("A.SZ", "L"), ("B.SZ", "L"), ("N.SZ", "L"), ("GONE.SZ", "D")] + [(f"{i}.BJ", "L") for i in range(25)]
                                 + [(f"{i}.SZ", "L") for i in range(300)], "ts_code string, list_status string")


@pytest.fixture
def aliases(spark):
    return spark.createDataFrame([("O.SZ", "N.SZ")], "old_code string, new_code string")


def quote(code, close=11.0, pre=10.0, **over):
    return {"ts_code": code, "trade_date": D, "open": 10.5, "high": 12.0, "low": 10.0, "close": close, "pre_close": pre, "change": close - (pre or 0),
            "pct_chg": 10.0, "vol": 5.0, "amount": 7.0, **over}


def core(make, aliases, stock, quotes, basics=None, factors=None, **kw):
    basics = [{"ts_code": q["ts_code"], "trade_date": D, "close": q["close"], "pe": 3.0, "total_share": 2.0} for q in quotes] if basics is None else basics
    factors = [{"ts_code": q["ts_code"], "trade_date": D, "adj_factor": 1.25} for q in quotes] if factors is None else factors
    return ds.stock_daily_core(make("daily", *quotes), make("daily_basic", *basics), make("adj_factor", *factors), aliases, stock, **kw)


def test_core_row(make, aliases, stock):
    out = core(make, aliases, stock, [quote("A.SZ", change=5.0)]).verify()
    r = out.rows.first()
    assert (r["change"], r["pct_chg"], r["volume"], r["amount"]) == (Decimal("1.000000"), Decimal("10.000000"), Decimal("500.0000"), Decimal("7000.0000"))
    assert (r["adj_factor"], r["pe"], r["total_share"], r["up_limit"]) == (Decimal("1.25000000"), Decimal("3.000000"), Decimal("20000.0000"), None)
    assert out.report("corrections").first()["corrected"] == ["change"]


def test_core_maps_aliases_and_drops_delisted(make, aliases, stock):
    out = core(make, aliases, stock, [quote("O.SZ"), quote("N.SZ", high=13.0), quote("GONE.SZ"), quote("A.SZ")]).verify()
    assert rows(out.rows, "ts_code", "high") == [("A.SZ", Decimal("12.000000")), ("N.SZ", Decimal("13.000000"))]
    assert rows(out.report("rejected"), "ts_code") == [("GONE.SZ",)]
    with pytest.raises(QualityError, match="alias conflict"):
        core(make, aliases, stock, [quote("O.SZ"), quote("O.SZ", high=13.0)]).verify()


def test_core_isolates_few_valuation_issues_and_stops_on_many(make, aliases, stock):
    quotes = [quote(f"{i}.SZ") for i in range(300)]
    good = [{"ts_code": q["ts_code"], "trade_date": D, "close": 11.0, "pe": 3.0} for q in quotes]
    few = [{**b, "close": 12.0} if i < 2 else b for i, b in enumerate(good[:-1])]
    out = core(make, aliases, stock, quotes, few).verify()
    assert out.rows.where("pe IS NULL").count() == 3 and out.rows.count() == 300
    assert {r["enrich_issue"] for r in out.report("enrich_issues").collect()} == {"close_mismatch", "missing"}
    many = [{**b, "close": 12.0} if i < 3 else b for i, b in enumerate(good[:-1])]
    with pytest.raises(QualityError, match="daily_basic"):
        core(make, aliases, stock, quotes, many).verify()


def test_core_isolates_a_lagging_segment(make, aliases, stock):
    quotes = [quote(f"{i}.BJ") for i in range(25)] + [quote("A.SZ")]
    basics = [{"ts_code": q["ts_code"], "trade_date": D, "close": 10.0 if ".BJ" in q["ts_code"] else 11.0, "pe": 3.0} for q in quotes]
    out = core(make, aliases, stock, quotes, basics).verify()
    assert rows(out.rows.where("pe IS NOT NULL"), "ts_code") == [("A.SZ",)]
    assert {r["enrich_issue"] for r in out.report("enrich_issues").collect()} == {"segment_lag"}


def test_core_failures(make, aliases, stock):
    with pytest.raises(QualityError, match="cover"):
        core(make, aliases, stock, [quote("A.SZ"), quote("B.SZ")], factors=[{"ts_code": "A.SZ", "trade_date": D, "adj_factor": 1.0}]).verify()
    with pytest.raises(QualityError, match="inconsistent prices"):
        core(make, aliases, stock, [quote("A.SZ", high=1.0)]).verify()
    with pytest.raises(QualityError, match="inconsistent prices"):
        core(make, aliases, stock, [quote("A.SZ", pre=0.0)]).verify()
    with pytest.raises(QualityError, match="invalid rows"):
        core(make, aliases, stock, [quote("A.SZ")], business_date=F.lit("2024-01-03").cast("date")).verify()
    with pytest.raises(QualityError, match="pre_close"):
        core(make, aliases, stock, [quote("A.SZ", pre=None), quote("B.SZ", pre=None)]).verify()
    one = core(make, aliases, stock, [quote("A.SZ", pre=None), quote("B.SZ")]).verify()
    assert rows(one.rows, "ts_code") == [("B.SZ",)] and rows(one.report("price_issues"), "ts_code") == [("A.SZ",)]


def test_core_carries_limits_over(make, aliases, stock):
    first = core(make, aliases, stock, [quote("A.SZ"), quote("B.SZ")]).rows.withColumn("up_limit", F.lit(12).cast("decimal(20,6)"))
    again = core(make, aliases, stock, [quote("A.SZ"), quote("B.SZ", close=11.5)], previous=first).verify()
    assert rows(again.rows, "ts_code", "up_limit") == [("A.SZ", Decimal("12.000000")), ("B.SZ", None)]


def test_limits_technical_flow_suspend(make, aliases, stock):
    base = core(make, aliases, stock, [quote("A.SZ"), quote("N.SZ")]).rows
    lim = lambda *r: ds.stock_daily_limit(make("stk_limit", *r), aliases, base)
    ok = lim({"ts_code": "A.SZ", "trade_date": D, "pre_close": None, "up_limit": 12.1}, {"ts_code": "O.SZ", "trade_date": D, "pre_close": 10.0},
             {"ts_code": "B.SZ", "trade_date": D, "pre_close": 1.0}).verify()
    assert rows(ok.rows, "ts_code", "up_limit") == [("A.SZ", Decimal("12.100000")), ("N.SZ", None)]
    assert rows(ok.report("rejected"), "ts_code") == [("B.SZ",)]
    with pytest.raises(QualityError, match="pre_close differs"):
        lim({"ts_code": "A.SZ", "trade_date": D, "pre_close": 10.5}).verify()
    tech = lambda c: ds.stock_technical_daily(make("stk_factor", {"ts_code": "A.SZ", "trade_date": D, "close": c, "macd": 0.123456789}), aliases, stock, base)
    assert tech(11.0).verify().rows.first()["macd"] == Decimal("0.12345679")
    with pytest.raises(QualityError, match="close differs"):
        tech(11.5).verify()
    flow = ds.stock_moneyflow_daily(make("moneyflow", {"ts_code": "A.SZ", "trade_date": D, "net_mf_vol": 3.0, "net_mf_amount": 2.5}), aliases, stock).verify()
    assert flow.rows.select("net_mf_vol", "net_mf_amount").first() == (Decimal("300.0000"), Decimal("25000.0000"))
    halt = ds.stock_suspend_daily(make("suspend_d", {"ts_code": "O.SZ", "trade_date": D, "suspend_type": "S"}), aliases, stock).verify()
    assert rows(halt.rows, "ts_code", "suspend_type") == [("N.SZ", "S")]
    with pytest.raises(QualityError):
        ds.stock_suspend_daily(make("suspend_d", {"ts_code": "A.SZ", "trade_date": D, "suspend_type": "Q"}), aliases, stock).verify()
    assert ds.stock_suspend_daily(make("suspend_d"), aliases, stock).verify().rows.count() == 0


def test_calendar(make, spark):
    import datetime as dt
    days = [(dt.date(2023, 1, 1) + dt.timedelta(i)).strftime("%Y%m%d") for i in range(365)]
    full = [{"exchange": e, "cal_date": d, "is_open": 1} for e in ("SSE", "SZSE") for d in days]
    assert ds.trade_calendar(make("trade_cal", *full)).verify().rows.where("is_open").count() == 730
    for broken in (full[:-1], full[:365], full + [full[0]], full + [{"exchange": "SSE", "cal_date": "20240101", "is_open": 7}]):
        with pytest.raises(QualityError):
            ds.trade_calendar(make("trade_cal", *broken)).verify()


def test_masters(make, stock):
    good = {"ts_code": "A.SZ", "symbol": "A", "name": " x ", "exchange": "SZSE", "list_status": "L", "list_date": "20200101"}
    assert ds.stock(make("stock_basic", good)).verify().rows.select("name", "list_date", "is_hs").first() == ("x", date(2020, 1, 1), None)
    for bad in ({"exchange": "NYSE"}, {"list_status": "X"}, {"is_hs": "Q"}, {"symbol": ""}, {"list_date": "2020"}):
        with pytest.raises(QualityError):
            ds.stock(make("stock_basic", {**good, **bad})).verify()
    company = ds.stock_company(make("stock_company", {"ts_code": "A.SZ", "reg_capital": 1.5, "employees": 7}, {"ts_code": "Z.SZ"}), stock).verify()
    assert rows(company.rows, "ts_code", "reg_capital", "employees") == [("A.SZ", Decimal("15000.0000"), 7)]
    fund = ds.etf(make("etf_basic", {"ts_code": "E", "exchange": "SH", "list_status": "L"})).verify().rows.first()
    assert (fund["exchange"], fund["source_exchange"]) == ("SSE", "SH")
    with pytest.raises(QualityError):
        ds.etf(make("etf_basic", {"ts_code": "E", "exchange": "BJ", "list_status": "L"})).verify()
    index = ds.market_index(make("index_basic", {"ts_code": "I", "name": "n", "market": "m", "desc": "d", "base_date": "19901219"})).verify()
    assert index.rows.select("description", "base_date").first() == ("d", date(1990, 12, 19))


def test_etf_and_index_facts(make, spark):
    master = spark.createDataFrame([("E",), ("I",)], "ts_code string")
    bar = {k: v for k, v in quote("E").items()}
    daily = ds.etf_daily(make("fund_daily", bar, {**bar, "ts_code": "X"}), make("fund_adj", {"ts_code": "Y", "trade_date": D, "adj_factor": 1.0}), master).verify()
    assert rows(daily.rows, "ts_code", "adj_factor", "volume") == [("E", None, Decimal("500.0000"))]
    assert rows(daily.report("extra_factors"), "ts_code") == [("Y",)] and rows(daily.report("rejected"), "ts_code") == [("X",)]
    size = ds.etf_share_size_daily(make(
        "etf_share_size", {"ts_code": "E", "trade_date": D, "total_share": 1.0, "total_size": 2.0, "exchange": "SSE"},
        {"ts_code": "E2", "trade_date": D, "total_share": 1.0, "exchange": "SSE"}), master).verify()
    assert rows(size.rows, "ts_code", "total_size") == [("E", Decimal("20000.0000"))] and size.report("dropped").count() == 1
    index = ds.market_index_daily(make("index_daily", {"ts_code": "I", "trade_date": D, "close": 3000.1, "vol": 2.0}), master).verify()
    assert rows(index.rows, "close", "volume") == [(Decimal("3000.100000"), Decimal("200.0000"))]
    with pytest.raises(QualityError, match="empty"):
        ds.market_index_daily(make("index_daily", {"ts_code": "Q", "trade_date": D, "close": 1.0}), master).verify()
    basic = ds.index_daily_basic(make("index_dailybasic", {"ts_code": "I", "trade_date": D, "pe": 12.5}), master).verify()
    assert basic.rows.first()["pe"] == Decimal("12.500000")
    month = F.lit("2024-01-01").cast("date")
    weight = {"index_code": "I", "con_code": "E", "trade_date": "20240131", "weight": 1.5}
    assert ds.market_index_weight(make("index_weight", weight, {**weight, "con_code": "Z"}), master, master, month).verify().rows.count() == 1
    with pytest.raises(QualityError):
        ds.market_index_weight(make("index_weight", {**weight, "trade_date": "20240201"}), master, master, month).verify()


def test_boards(make, stock, spark):
    feed = make("ths_index", {"ts_code": "1", "name": "c", "type": "N", "count": 5}, {"ts_code": "2", "name": "t", "type": "TH"}, {"ts_code": "3", "name": "o", "type": "I"})
    concepts, themes = ds.concept_board(feed).verify().rows, ds.theme_index(feed).verify().rows
    assert rows(concepts, "ts_code", "member_count", "board_type") == [("1", 5, "N")] and rows(themes, "ts_code", "theme_type") == [("2", "TH")]
    bars = [{"ts_code": str(i), "trade_date": D, "close": 1.0 if i else None, "vol": 2.0} for i in range(30)]
    daily = ds.concept_board_daily(make("ths_daily", *bars), concepts).verify()
    assert rows(daily.rows, "ts_code", "volume") == [("1", Decimal("200.0000"))] and daily.report("isolated").count() == 1
    with pytest.raises(QualityError, match="missing closes"):
        ds.theme_index_daily(make("ths_daily", *[{**b, "close": None} for b in bars]), themes).verify()
    seen = F.lit("2024-01-05").cast("date")
    member = [{"ts_code": "1", "con_code": "A.SZ", "is_new": "Y"}, {"ts_code": "1", "con_code": "B.SZ", "is_new": "N"}, {"ts_code": "2", "con_code": "A.SZ", "is_new": "Y"}]
    assert rows(ds.concept_board_member(make("ths_member", *member), concepts, stock, seen).verify().rows, "ts_code", "con_code") == [("1", "A.SZ")]
    assert rows(ds.theme_index_member(make("ths_member", *member), themes, stock, seen).verify().rows, "ts_code") == [("2",)]
    with pytest.raises(QualityError, match="empty"):
        ds.theme_index_member(make("ths_member", member[0]), themes, stock, seen).verify()


def test_themes_and_flows(make, stock):
    theme = ds.market_theme_daily(make("dc_concept", {"theme_code": "t", "trade_date": D, "name": "n", "sort": 3, "hot": 1.5})).verify()
    assert theme.rows.select("rank", "hot").first() == (3, Decimal("1.500000"))
    m = {"ts_code": "A.SZ", "trade_date": D, "theme_code": "t", "hot_num": 1}
    assert ds.market_theme_member_daily(make("dc_concept_cons", m, m, {**m, "ts_code": "?"}), stock).verify().rows.count() == 1
    with pytest.raises(QualityError, match="conflicting"):
        ds.market_theme_member_daily(make("dc_concept_cons", m, {**m, "hot_num": 2}), stock).verify()
    flow = ds.ths_board_moneyflow_daily(
        make("moneyflow_cnt_ths", {"trade_date": D, "name": "c", "close_price": 1.0, "industry_index": 2.0, "net_amount": 0.5}),
        make("moneyflow_ind_ths", {"trade_date": D, "ts_code": "i", "industry": "d", "close": 3.0, "close_price": 4.0})).verify()
    assert rows(flow.rows, "board_type", "board_name", "lead_stock_price", "board_index", "net_amount") == [
        ("CONCEPT", "c", Decimal("1.000000"), Decimal("2.000000"), Decimal("50000000.0000")), ("INDUSTRY", "d", Decimal("3.000000"), Decimal("4.000000"), None)]


def test_hot_ranks(make, stock):
    def hot(code, rank, at, **over):
        return {"trade_date": D, "ts_code": code, "rank": rank, "rank_time": at, "concept": "[\"x\"]", **over}

    ths = make("ths_hot", hot("A.SZ", 1, "10:00:00"), hot("B.SZ", 2, "10:00:00"), hot("B.SZ", 1, "10:00:00"), hot("A.SZ", 2, "10:30:00"), hot("A.SZ", 1, "11:00:00"))
    dc = make("dc_hot", hot("A.SZ", 1, "20240102100000"), hot("B.SZ", 2, "20240102100000"), hot("A.SZ", 1, "20240102110000"))
    out = ds.stock_hot_rank_daily(ths.withColumn("scope_key", F.lit("m=1")), dc.withColumn("scope_key", F.lit("m=1;hot_type=UP")), stock, chunk_rows=2).verify()
    assert rows(out.rows, "source", "rank_type", "ts_code", "rank") == [
        ("DC", "UP", "A.SZ", 1), ("DC", "UP", "B.SZ", 2), ("THS", "FINAL", "A.SZ", 2), ("THS", "FINAL", "B.SZ", 1)]
    twice = make("dc_hot", hot("A.SZ", 1, "100000"), hot("B.SZ", 1, "100000")).withColumn("scope_key", F.lit("hot_type=UP"))
    with pytest.raises(QualityError, match="not unique"):
        ds.stock_hot_rank_daily(None, twice, stock).verify()


def test_top_list_and_limits(make, stock):
    t = {"trade_date": D, "ts_code": "A.SZ", "reason": "r", "name": "n", "close": 10.0, "amount": 1000000.0}
    out = ds.stock_top_list_daily(make("top_list", t, {**t, "name": "m", "amount": 1000000.25}, {**t, "ts_code": "B.SZ"}, {**t, "ts_code": "B.SZ", "close": 11.0}), stock).verify()
    assert rows(out.rows, "ts_code", "name", "amount") == [("A.SZ", "n", Decimal("1000000.2500"))]
    assert rows(out.report("quarantined"), "ts_code") == [("B.SZ",)]
    inst = {"trade_date": D, "ts_code": "A.SZ", "exalter": "seat", "side": 1, "reason": "r", "buy": 2.0}
    assert ds.stock_top_inst_daily(make("top_inst", inst, inst), stock).verify().rows.count() == 2
    with pytest.raises(QualityError):
        ds.stock_top_inst_daily(make("top_inst", {**inst, "side": 2}), stock).verify()
    event = {"trade_date": D, "ts_code": "A.SZ", "limit": "U", "first_time": "93000", "last_time": "14:59:59", "amount": 3.0}
    got = ds.stock_limit_event_daily(make("limit_list_d", event), stock).verify().rows.select("limit_type", "first_time", "last_time", "amount_raw").first()
    assert got == ("U", "09:30:00", "14:59:59", Decimal("3.0000"))
    with pytest.raises(QualityError):
        ds.stock_limit_event_daily(make("limit_list_d", {**event, "limit": "Q"}), stock).verify()
    assert ds.stock_limit_step_daily(make("limit_step", {"trade_date": D, "ts_code": "A.SZ", "nums": 2}), stock).verify().rows.first()["nums"] == 2
    with pytest.raises(QualityError):
        ds.stock_limit_step_daily(make("limit_step", {"trade_date": D, "ts_code": "A.SZ", "nums": 0}), stock).verify()


def test_registry_is_complete(spark):
    assert len(ds.DATASETS) == 29 and len(FEEDS) == 31
    used = {i for d in ds.DATASETS.values() for i in d.inputs}
    assert used == set(FEEDS)
    target = spark.createDataFrame([("a", "d1", 1), ("b", "d2", 2)], "ts_code string, trade_date string, v int")
    stage = spark.createDataFrame([("c", "d1", 3)], target.schema)
    assert rows(ds.DATASETS["etf_daily"].publish(target, stage), "ts_code") == [("b",), ("c",)]
    assert rows(ds.DATASETS["etf_daily"].publish(target, stage.where("false"), stage), "ts_code") == [("b",)]
    assert rows(ds.DATASETS["stock_daily.limit"].publish(target, stage.withColumn("ts_code", F.lit("a"))), "ts_code", "v") == [("a", 3), ("b", 2)]


def test_newest_capture_over_spellings_of_a_time(spark, make, stock):
    """Two spellings of a time, and a missing one, are one capture each; what the checks read is written once."""
    base = {"trade_date": D, "data_type": "x", "ts_name": "n", "hot": 1.0}
    times = ["09:00:00", "90000", "10:00:00", None, "22:30:00"]
    dc = make("dc_hot", *[{**base, "ts_code": f"{i}.SZ", "rank": i, "rank_time": t} for i, t in enumerate(times)]).withColumn("scope_key", F.lit("m=1;hot_type=UP"))
    out = ds.stock_hot_rank_daily(None, dc, stock).verify()
    assert rows(out.rows, "ts_code") == [("3.SZ",), ("4.SZ",)]
    assert any("hot-captures" in f for f in out.rows.inputFiles())


def once(names):
    """A ``keep`` that notes what it writes; afterwards nothing may read the raw feeds again."""
    def keep(rows, name):
        names.append(name)
        return written(rows, name)
    return keep


def raw_scans(df):
    """Reads of hand-written feeds, told by a column that only they have."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("_ord#")


def test_core_checks_and_rows_read_feeds_written_once(make, aliases, stock):
    quotes, names = [quote("A.SZ"), quote("B.SZ", pre=None), quote("O.SZ", close=10.5)], []
    out = core(make, aliases, stock, quotes, keep=once(names))
    assert names == ["daily", "daily_basic", "adj_factor", "enriched"]
    assert raw_scans(out.rows) == 0 and sum(raw_scans(c.frame()) > 0 for c in out.checks) == 3  # only the alias conflicts read what was delivered
    assert rows(out.rows) == rows(core(make, aliases, stock, quotes).rows)
    spoiled = core(make, aliases, stock, [quote("A.SZ"), quote("B.SZ", vol=None)], keep=once([]))
    assert rows(next(c for c in spoiled.checks if c.message == "daily: invalid rows").frame(), "ts_code", "_bad") == [("B.SZ", "invalid volume")]


def test_weights_are_cleaned_once(make, stock):
    weight, names = {"index_code": "A.SZ", "con_code": "B.SZ", "trade_date": D, "weight": 2.5}, []
    master, month = stock.select("ts_code"), F.lit("2024-01-01").cast("date")
    out = ds.market_index_weight(make("index_weight", weight, {**weight, "con_code": "Z"}), master, master, month, keep=once(names))
    assert names == ["market_index_weight"] and [raw_scans(df) for df in (out.rows, *[c.frame() for c in out.checks])] == [0, 0, 0]
    assert rows(out.verify().rows, "con_code", "weight") == [("B.SZ", Decimal("2.5"))]
    for spoiled, why in (({"trade_date": "20240201"}, "invalid rows"), ({}, "key not unique")):
        with pytest.raises(QualityError, match=why):
            ds.market_index_weight(make("index_weight", weight, {**weight, **spoiled}), master, master, month, keep=once([])).verify()


def test_members_are_cleaned_and_collapsed_once(make, stock):
    m, names = {"trade_date": D, "theme_code": "T1", "ts_code": "A.SZ", "hot_num": 1}, []
    out = ds.market_theme_member_daily(make("dc_concept_cons", m, m, {**m, "ts_code": "?"}), stock, keep=once(names))
    assert names == ["dc_concept_cons", "distinct"] and [raw_scans(df) for df in (out.rows, *[c.frame() for c in out.checks])] == [0, 0, 0]
    assert rows(out.verify().rows, "ts_code", "hot_num") == [("A.SZ", 1)]
    for spoiled, why in (({"hot_num": 2}, "conflicting duplicates"), ({"theme_code": " "}, "invalid rows")):
        with pytest.raises(QualityError, match=why):
            ds.market_theme_member_daily(make("dc_concept_cons", m, {**m, **spoiled}), stock, keep=once([])).verify()
