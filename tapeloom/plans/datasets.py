"""The 29 published datasets: short compositions of the operators.

Every preset takes raw frames (declared in ``sources.feeds``) and master tables, and
returns a ``Prepared``. Without a business date a preset works on all dates of its input at
once, which is how a backfill runs as one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom import types as tt
from tapeloom.functions import scalar as sc
from tapeloom.functions.predicates import ohlc_invalid
from tapeloom.operators import dedup as dd
from tapeloom.operators import joins as jn
from tapeloom.operators import publish as pb
from tapeloom.operators import quality as qa
from tapeloom.operators.sets import union_tagged
from tapeloom.plans import cleaning as cl
from tapeloom.plans.cleaning import Check, Prepared
from tapeloom.session import written

KEY = ["ts_code", "trade_date"]
PRICES = "open high low close pre_close"

Report = Callable[[], DataFrame]

# Code lists.
LISTING = ("L", "D", "P", "G")
EXCHANGES = ("SSE", "SZSE", "BSE")
ETF_EXCHANGE = {"SH": "SSE", "SZ": "SZSE"}
RATIOS = "turnover_rate turnover_rate_f volume_ratio dv_ratio dv_ttm"
MULTIPLES = "pe pe_ttm pb ps ps_ttm"
SHARES = "total_share float_share free_share total_mv circ_mv"
ADJUSTED = ("open_hfq open_qfq close_hfq close_qfq high_hfq high_qfq low_hfq low_qfq pre_close_hfq pre_close_qfq")
INDICATORS = "macd_dif macd_dea macd kdj_k kdj_d kdj_j rsi_6 rsi_12 rsi_24 boll_upper boll_mid boll_lower cci"
FLOW_VOLUMES = "buy_sm_vol sell_sm_vol buy_md_vol sell_md_vol buy_lg_vol sell_lg_vol buy_elg_vol sell_elg_vol net_mf_vol"
FLOW_AMOUNTS = FLOW_VOLUMES.replace("_vol", "_amount")


def _listed(rows: DataFrame, master: DataFrame, *, active: bool = False) -> tuple[DataFrame, Report]:
    """Rows in a master (optionally not delisted), and how to get the rejected ones."""
    gone = F.col("list_status") == "D" if active else None
    mapping = {"ts_code": "ts_code"}
    return jn.in_master(rows, master, mapping, exclude=gone), lambda: jn.not_in_master(rows, master, mapping, exclude=gone)


def _simple(df: DataFrame, name: str, keys: list[str], *groups: list[cl.Out], keep: cl.Keep | None = None) -> Prepared:
    rows, check = cl.usable(cl.cleaned(df, *groups), name, keep)
    return Prepared(rows, [check, cl.unique(rows, keys, name)])


# ---------------------------------------------------------------- masters


def trade_calendar(raw: DataFrame, required: tuple[str, ...] = ("SSE", "SZSE")) -> Prepared:
    out = _simple(raw, "trade_calendar", ["exchange", "cal_date"], cl.text("exchange", required=True),
                  cl.days("cal_date", required=True), cl.flags("is_open"), cl.days("pretrade_date"))
    out.checks += [
        Check(lambda: qa.missing_exchanges(out.rows, required), "trade_calendar: exchange missing"),
        Check(lambda: out.rows.where(~F.col("exchange").isin(*required)), "trade_calendar: unexpected exchange"),
        Check(lambda: qa.calendar_completeness(out.rows), "trade_calendar: year incomplete", "complete"),
    ]
    return out


def stock(raw: DataFrame) -> Prepared:
    return _simple(
        raw, "stock", ["ts_code"], cl.text("ts_code symbol name", required=True),
        cl.text("area industry fullname enname cnspell market"), cl.choice("exchange", EXCHANGES), cl.text("curr_type"),
        cl.choice("list_status", LISTING), cl.days("list_date delist_date"), cl.choice("is_hs", ("N", "H", "S"), nullable=True),
        cl.text("act_name act_ent_type"))


def stock_company(raw: DataFrame, stock_master: DataFrame) -> Prepared:
    out = _simple(
        raw, "stock_company", ["ts_code"], cl.text("ts_code", required=True),
        cl.text("com_name com_id exchange chairman manager secretary"), cl.scaled(10_000, "reg_capital"), cl.days("setup_date"),
        cl.text("province city introduction website email office"), cl.whole("employees"), cl.text("main_business business_scope"))
    out.rows, out.reports["rejected"] = _listed(out.rows, stock_master)
    return out


def etf(raw: DataFrame) -> Prepared:
    exchange = sc.recode(sc.clean_text("exchange"), ETF_EXCHANGE)
    return _simple(
        raw, "etf", ["ts_code"], cl.text("ts_code", required=True), cl.text("csname extname cname index_code index_name"),
        cl.days("setup_date list_date"), cl.choice("list_status", ("L", "D", "P")),
        [cl.Out("exchange", exchange, exchange.isNull(), "invalid exchange"), cl.Out("source_exchange", sc.clean_text("exchange"))],
        cl.text("mgr_name custod_name"), cl.numbers(tt.WEIGHT, "mgt_fee"), cl.text("etf_type"))


def market_index(raw: DataFrame) -> Prepared:
    return _simple(
        raw, "market_index", ["ts_code"], cl.text("ts_code name market", required=True),
        cl.text("fullname publisher index_type category weight_rule"), cl.days("base_date list_date exp_date"),
        cl.numbers(tt.PRICE, "base_point"), [cl.Out("description", sc.clean_text("desc"))])


# ---------------------------------------------------------------- ETF and index facts


def etf_daily(daily: DataFrame, factor: DataFrame, etf_master: DataFrame, business_date: Column | None = None) -> Prepared:
    """ETF bars with optional factors; factors without a bar are reported."""
    bars, bars_ok = cl.usable(cl.cleaned(
        daily, cl.text("ts_code", required=True), cl.dated(business_date), cl.numbers(tt.PRICE, f"{PRICES} change", required=True),
        cl.numbers(tt.RATIO, "pct_chg", required=True), cl.scaled(100, volume="vol", required=True),
        cl.scaled(1_000, amount="amount", required=True)), "fund_daily")
    factors, factors_ok = cl.usable(cl.cleaned(
        factor, cl.text("ts_code", required=True), cl.dated(business_date), cl.numbers(tt.FACTOR, "adj_factor", required=True)), "fund_adj")
    rows, rejected = _listed(jn.optional_enrich(bars, factors, KEY, ["adj_factor"]), etf_master)
    return Prepared(rows, [bars_ok, factors_ok, cl.unique(bars, KEY, "fund_daily"), cl.unique(factors, KEY, "fund_adj")],
                    {"rejected": rejected, "extra_factors": lambda: jn.extra_keys(factors, bars, KEY)}, [(rows, "etf_daily: empty day")])


def etf_share_size_daily(raw: DataFrame, etf_master: DataFrame, business_date: Column | None = None) -> Prepared:
    """Rows without a share count or size are dropped and counted."""
    blank = sc.clean_text("total_share").isNull() | sc.clean_text("total_size").isNull()
    kept, dropped = qa.split_rejects(raw, F.when(blank, "size missing"))
    out = _simple(
        kept, "etf_share_size_daily", KEY, cl.text("ts_code", required=True), cl.dated(business_date), cl.text("etf_name"),
        cl.scaled(10_000, "total_share total_size", required=True), cl.numbers(tt.NAV, "nav"), cl.numbers(tt.PRICE, "close"),
        cl.choice("exchange", EXCHANGES))
    out.rows, out.reports["rejected"] = _listed(out.rows, etf_master)
    out.reports["dropped"] = lambda: dropped
    return out


def market_index_daily(raw: DataFrame, index_master: DataFrame, business_date: Column | None = None) -> Prepared:
    out = _simple(
        raw, "market_index_daily", KEY, cl.text("ts_code", required=True), cl.dated(business_date), cl.numbers(tt.PRICE, "close", required=True),
        cl.numbers(tt.PRICE, "open high low pre_close change"), cl.numbers(tt.RATIO, "pct_chg"), cl.scaled(100, volume="vol"),
        cl.scaled(1_000, "amount"))
    out.rows, out.reports["rejected"] = _listed(out.rows, index_master)
    out.required.append((out.rows, "market_index_daily: empty day"))
    return out


def index_daily_basic(raw: DataFrame, index_master: DataFrame, business_date: Column | None = None) -> Prepared:
    out = _simple(
        raw, "index_daily_basic", KEY, cl.text("ts_code", required=True), cl.dated(business_date),
        cl.numbers(tt.QUANTITY, "total_mv float_mv total_share float_share free_share"), cl.numbers(tt.RATIO, "turnover_rate turnover_rate_f"),
        cl.numbers(tt.PRICE, "pe pe_ttm pb"))
    out.rows, out.reports["rejected"] = _listed(out.rows, index_master)
    return out


def market_index_weight(
    raw: DataFrame, index_master: DataFrame, stock_master: DataFrame, month: Column | None = None, *, keep: cl.Keep | None = None,
) -> Prepared:
    """Index members of one month; published by replacing (index, month). ``keep`` writes the cleaned feed once for checks and result."""
    day = sc.strict_date("trade_date")
    off = day.isNull() if month is None else ~F.trunc(day, "MM").eqNullSafe(month)
    out = _simple(
        raw, "market_index_weight", ["index_code", "snapshot_date", "con_code"], cl.text("index_code con_code", required=True),
        [cl.Out("snapshot_date", day, off, "wrong month")], cl.numbers(tt.WEIGHT, "weight", required=True), keep=keep)
    out.rows = jn.in_both_masters(out.rows, index_master, stock_master, topic={"index_code": "ts_code"}, member={"con_code": "ts_code"})
    return out


# ---------------------------------------------------------------- stock facts


def _canonical(raw: DataFrame, aliases: DataFrame, name: str, keys: list[str], matching: list[str] | None = None) -> tuple[DataFrame, list[Check], dict[str, Report]]:
    """Alias-mapped, deduplicated raw rows with their conflict check and report."""
    mapped = dd.map_alias(raw, aliases)
    fields = matching or [c for c in raw.columns if c not in (*keys, "_ord", "_asset", "_row")]
    rows = dd.dedup_alias(mapped, keys, "_ord").drop("is_alias", "source_code")
    return rows, [Check(lambda: dd.alias_conflicts(mapped, keys, fields, order="_ord"), f"{name}: alias conflict")], {f"{name}_aliases": lambda: dd.alias_report(mapped, keys)}


def stock_daily_core(
    daily: DataFrame, basic: DataFrame, factor: DataFrame, aliases: DataFrame, stock_master: DataFrame, *,
    business_date: Column | None = None, previous: DataFrame | None = None, patch_dates: DataFrame | None = None, keep: cl.Keep | None = None,
) -> Prepared:
    """Quotes with adjustment factors and, where both sources agree, valuation columns.

    Change and percent change are always recomputed. A market segment whose valuation feed
    repeats the previous close is left without valuation as a whole. Few defects are
    isolated and reported, many stop the batch. With a previous version, limit prices are
    carried over where prices did not move. All checks and the result read the same cleaned
    feeds: ``keep`` writes them once where more than one is wanted.
    """
    d_raw, checks, reports = _canonical(daily, aliases, "daily", KEY)
    b_raw, more, rep = _canonical(basic, aliases, "daily_basic", KEY)
    f_raw, last, rep2 = _canonical(factor, aliases, "adj_factor", KEY)
    checks, reports = checks + more + last, {**reports, **rep, **rep2}
    base = [cl.text("ts_code", required=True), cl.dated(business_date)]
    quotes, ok = cl.usable(cl.cleaned(
        d_raw, *base, cl.numbers(tt.PRICE, "open high low close", required=True), cl.numbers(tt.PRICE, "pre_close"),
        cl.numbers(tt.PRICE, source_change="change"), cl.numbers(tt.RATIO, source_pct="pct_chg"),
        cl.scaled(100, volume="vol", required=True), cl.scaled(1_000, amount="amount", required=True),
        cl.scaled(100, after_hours_volume="ah_vol"), cl.scaled(1_000, after_hours_amount="ah_amount")), "daily", keep)
    values, values_ok = cl.usable(cl.cleaned(
        b_raw, *base, cl.numbers(tt.PRICE, basic_close="close"), cl.numbers(tt.RATIO, RATIOS), cl.numbers(tt.PRICE, MULTIPLES),
        cl.scaled(10_000, SHARES)), "daily_basic", keep)
    factors, factors_ok = cl.usable(cl.cleaned(f_raw, *base, cl.numbers(tt.FACTOR, "adj_factor", required=True)), "adj_factor", keep)
    checks += [ok, values_ok, factors_ok, Check(lambda: jn.uncovered(quotes, factors, KEY), "adj_factor does not cover daily"),
               Check(lambda: quotes.where(ohlc_invalid() | (F.col("pre_close") <= 0)), "daily: inconsistent prices")]

    bse = F.col("ts_code").endswith(".BJ")
    pairs = quotes.join(values.select(*KEY, "basic_close"), KEY)
    lag = qa.segment_lag(pairs, ["trade_date"], bse, close="close", pre_close="pre_close", other_close="basic_close")
    tagged = quotes.join(lag.select("trade_date", "lagging"), "trade_date", "left")
    columns = f"{RATIOS} {MULTIPLES} {SHARES}".split()
    enriched = jn.tolerant_enrich(
        tagged, values, KEY, left_close="close", right_close="basic_close", columns=columns,
        isolate=bse & F.coalesce("lagging", F.lit(False))).drop("lagging")
    if keep is not None:
        enriched = keep(enriched, "enriched")

    def issues() -> DataFrame:
        extra = jn.extra_keys(values, quotes, KEY)
        return enriched.select(*KEY, "enrich_issue", F.lit(True).alias("quoted")).unionByName(
            extra.select(*KEY, F.lit("no daily row").alias("enrich_issue"), F.lit(False).alias("quoted")))

    def gate() -> DataFrame:
        required = ~F.col("ts_code").endswith(".BJ")
        return qa.anomaly_gate(
            issues(), ["trade_date"], F.col("enrich_issue").isNotNull(), counted=required, total=required & F.col("quoted"))

    checks += [
        Check(gate, "daily_basic: too many anomalies", "passed"),
        Check(lambda: qa.anomaly_gate(quotes, ["trade_date"], F.col("pre_close").isNull()), "daily: too many rows without pre_close", "passed"),
    ]
    flags = sc.correction_flags("close", "pre_close", "source_change", "source_pct")
    priced = jn.covered_join(enriched.where(F.col("pre_close").isNotNull()), factors, KEY, ["adj_factor"])
    rows = priced.withColumns({
        "change": sc.price_change("close", "pre_close"), "pct_chg": sc.pct_change("close", "pre_close"),
        "limit_status": F.lit(None).cast("smallint"), "up_limit": F.lit(None).cast(tt.PRICE), "down_limit": F.lit(None).cast(tt.PRICE)})
    reports |= {
        "corrections": lambda: priced.select(*KEY, flags.alias("corrected")).where(F.size("corrected") > 0),
        "enrich_issues": lambda: issues().where(F.col("enrich_issue").isNotNull()).drop("quoted"),
        "price_issues": lambda: enriched.where(F.col("pre_close").isNull()).select(*KEY),
        "extra_factors": lambda: jn.extra_keys(factors, quotes, KEY),
    }
    rows = rows.drop("source_change", "source_pct", "enrich_issue")
    rows, reports["rejected"] = _listed(rows, stock_master, active=True)
    if previous is not None:
        rows = pb.carry_over(rows, previous, KEY, ["limit_status", "up_limit", "down_limit"], valid_dates=patch_dates)
    return Prepared(rows, checks, reports, [(rows, "stock_daily.core: empty day")])


def stock_daily_limit(raw: DataFrame, aliases: DataFrame, core: DataFrame, business_date: Column | None = None) -> Prepared:
    """Limit prices for published quotes; a disagreeing previous close stops the batch."""
    src, checks, reports = _canonical(raw, aliases, "stk_limit", KEY, ["pre_close", "up_limit", "down_limit"])
    rows, ok = cl.usable(cl.cleaned(
        src, cl.text("ts_code", required=True), cl.dated(business_date), cl.numbers(tt.PRICE, source_pre_close="pre_close"),
        cl.numbers(tt.PRICE, "up_limit down_limit")), "stk_limit")
    same = {k: k for k in KEY}
    checks += [ok, Check(lambda: jn.inconsistent(core, rows, KEY, "pre_close", "source_pre_close"), "stk_limit: pre_close differs from core")]
    reports["rejected"] = lambda: jn.not_in_master(rows, core, same)
    return Prepared(jn.in_master(rows, core, same).drop("source_pre_close"), checks, reports, [(rows, "stock_daily.limit: empty day")])


def stock_technical_daily(raw: DataFrame, aliases: DataFrame, stock_master: DataFrame, core: DataFrame, business_date: Column | None = None) -> Prepared:
    src, checks, reports = _canonical(
        raw, aliases, "stk_factor", KEY, ["open", "high", "low", "close", "pre_close", "change", "pct_change", "vol", "amount"])
    rows, ok = cl.usable(cl.cleaned(
        src, cl.text("ts_code", required=True), cl.dated(business_date), cl.numbers(tt.PRICE, source_close="close", required=True),
        cl.numbers(tt.PRICE, ADJUSTED), cl.numbers(tt.INDICATOR, INDICATORS)), "stk_factor")
    kept, reports["rejected"] = _listed(rows, stock_master, active=True)
    checks += [ok, Check(lambda: jn.inconsistent(core, kept, KEY, "close", "source_close"), "stk_factor: close differs from core")]
    return Prepared(kept.drop("source_close"), checks, reports, [(rows, "stock_technical_daily: empty day")])


def stock_moneyflow_daily(raw: DataFrame, aliases: DataFrame, stock_master: DataFrame, business_date: Column | None = None) -> Prepared:
    src, checks, reports = _canonical(raw, aliases, "moneyflow", KEY)
    rows, ok = cl.usable(cl.cleaned(
        src, cl.text("ts_code", required=True), cl.dated(business_date), cl.scaled(100, FLOW_VOLUMES), cl.scaled(10_000, FLOW_AMOUNTS)), "moneyflow")
    kept, reports["rejected"] = _listed(rows, stock_master, active=True)
    return Prepared(kept, checks + [ok], reports, [(rows, "stock_moneyflow_daily: empty day")])


def stock_suspend_daily(raw: DataFrame, aliases: DataFrame, stock_master: DataFrame, business_date: Column | None = None) -> Prepared:
    """Halts and resumptions; an empty day is valid."""
    src, checks, reports = _canonical(raw, aliases, "suspend_d", [*KEY, "suspend_type"])
    rows, ok = cl.usable(cl.cleaned(
        src, cl.text("ts_code", required=True), cl.dated(business_date), cl.choice("suspend_type", ("S", "R")), cl.text("suspend_timing")), "suspend_d")
    kept, reports["rejected"] = _listed(rows, stock_master, active=True)
    return Prepared(kept, checks + [ok], reports)


# ---------------------------------------------------------------- boards and themes


def _board(raw: DataFrame, kind: str, type_column: str, name: str) -> Prepared:
    return _simple(
        raw.where(sc.clean_text("type") == kind), name, ["source", "ts_code"], cl.const("source", "THS"), cl.text("ts_code name", required=True),
        cl.whole(member_count="count"), cl.text("exchange"), cl.days("list_date"), [cl.Out(type_column, sc.clean_text("type"))])


def concept_board(raw: DataFrame) -> Prepared:
    return _board(raw, "N", "board_type", "concept_board")


def theme_index(raw: DataFrame) -> Prepared:
    return _board(raw, "TH", "theme_type", "theme_index")


def _board_daily(raw: DataFrame, boards: DataFrame, name: str, business_date: Column | None) -> Prepared:
    """Board bars; rows without a close are isolated while there are few of them."""
    missing = sc.clean_text("close").isNull()
    day = raw.select("trade_date", missing.alias("missing"))
    out = _simple(
        raw.where(~missing), name, KEY, cl.const("source", "THS"), cl.text("ts_code", required=True), cl.dated(business_date),
        cl.numbers(tt.PRICE, "close", required=True), cl.numbers(tt.PRICE, "open high low pre_close avg_price change"),
        cl.numbers(tt.RATIO, "pct_change turnover_rate"), cl.scaled(100, volume="vol"), cl.numbers(tt.QUANTITY, "total_mv float_mv"))
    out.checks.append(Check(lambda: qa.anomaly_gate(day, ["trade_date"], F.col("missing")), f"{name}: too many missing closes", "passed"))
    out.rows, out.reports["rejected"] = _listed(out.rows, boards)
    out.reports["isolated"] = lambda: raw.where(missing)
    return out


def concept_board_daily(raw: DataFrame, boards: DataFrame, business_date: Column | None = None) -> Prepared:
    return _board_daily(raw, boards, "concept_board_daily", business_date)


def theme_index_daily(raw: DataFrame, themes: DataFrame, business_date: Column | None = None) -> Prepared:
    return _board_daily(raw, themes, "theme_index_daily", business_date)


def _board_members(raw: DataFrame, boards: DataFrame, stock_master: DataFrame, observed_at: Column, name: str) -> Prepared:
    out = _simple(
        raw.where(sc.clean_text("is_new") == "Y"), name, ["source", "ts_code", "con_code"], cl.const("source", "THS"),
        cl.text("ts_code con_code", required=True), cl.text("con_name"), cl.numbers(tt.WEIGHT, "weight"), cl.days("in_date out_date"),
        cl.const("is_current", True), cl.const("observed_at", observed_at))
    out.rows = jn.in_both_masters(out.rows, boards, stock_master, topic={"ts_code": "ts_code"}, member={"con_code": "ts_code"})
    return out


def concept_board_member(raw: DataFrame, boards: DataFrame, stock_master: DataFrame, observed_at: Column) -> Prepared:
    return _board_members(raw, boards, stock_master, observed_at, "concept_board_member")


def theme_index_member(raw: DataFrame, themes: DataFrame, stock_master: DataFrame, observed_at: Column) -> Prepared:
    out = _board_members(raw, themes, stock_master, observed_at, "theme_index_member")
    out.required.append((out.rows, "theme_index_member: empty"))
    return out


def market_theme_daily(raw: DataFrame, business_date: Column | None = None) -> Prepared:
    return _simple(
        raw, "market_theme_daily", ["source", "theme_code", "trade_date"], cl.const("source", "DC"), cl.text("theme_code name", required=True),
        cl.dated(business_date), cl.numbers(tt.RATIO, "pct_change"), cl.numbers(tt.SCORE, "hot"), cl.whole("z_t_num", rank="sort"),
        cl.numbers(tt.SCORE, "strength main_change"), cl.text("lead_stock lead_stock_code"), cl.numbers(tt.RATIO, "lead_stock_pct_change"))


def market_theme_member_daily(
    raw: DataFrame, stock_master: DataFrame, business_date: Column | None = None, *, keep: cl.Keep | None = None,
) -> Prepared:
    """Dated theme members; byte-equal copies across pages collapse, other repeats stop the batch.

    ``keep`` writes the cleaned feed and its distinct rows once for checks and result.
    """
    rows, ok = cl.usable(cl.cleaned(
        raw, cl.const("source", "DC"), cl.dated(business_date), cl.text("theme_code ts_code", required=True),
        cl.text("name industry_code industry reason"), cl.whole("hot_num")), "dc_concept_cons", keep)
    keys = ["source", "trade_date", "theme_code", "ts_code"]
    single, conflicts = dd.dedup_exact(rows, keys, keep=keep)
    kept, rejected = _listed(single, stock_master)
    return Prepared(kept.drop("copies"), [ok, Check(lambda: conflicts, "dc_concept_cons: conflicting duplicates")],
                    {"rejected": rejected, "duplicates": lambda: single.where("copies > 1")})


def ths_board_moneyflow_daily(concept: DataFrame, industry: DataFrame, business_date: Column | None = None) -> Prepared:
    """Concept and industry flow feeds, which name price and index columns differently."""
    def side(df: DataFrame, board: str, price: str, index: str, code: list[cl.Out]) -> cl.Cleaned:
        return cl.cleaned(
            df, [cl.Out("board_name", sc.clean_text(board), sc.clean_text(board).isNull(), "board_name is required")], code, cl.dated(business_date),
            cl.text("lead_stock"), cl.numbers(tt.PRICE, lead_stock_price=price, board_index=index), cl.numbers(tt.RATIO, "pct_change"),
            cl.whole("company_num"), cl.numbers(tt.RATIO, lead_stock_pct_change="pct_change_stock"),
            cl.scaled(100_000_000, "net_buy_amount net_sell_amount net_amount"))

    parts = {
        "CONCEPT": cl.usable(side(concept, "name", "close_price", "industry_index", cl.text("ts_code")), "moneyflow_cnt_ths"),
        "INDUSTRY": cl.usable(side(industry, "industry", "close", "close_price", cl.text("ts_code")), "moneyflow_ind_ths")}
    rows = union_tagged({name: frame for name, (frame, _) in parts.items()}, "board_type")
    checks = [check for _, check in parts.values()]
    return Prepared(rows, [*checks, cl.unique(rows, ["board_type", "trade_date", "board_name"], "board_moneyflow")])


# ---------------------------------------------------------------- hot lists, top lists, limits


def _hot_rows(df: DataFrame, source: str, rank_type: Column, business_date: Column | None) -> cl.Cleaned:
    market = {"THS": "A股", "DC": "A股市场"}[source]
    reason = [] if "rank_reason" in df.columns else cl.const("rank_reason", F.lit(None).cast("string"))
    return cl.cleaned(
        df, cl.const("source", source), cl.dated(business_date), cl.const("market_type", market), cl.const("rank_type", rank_type),
        cl.text("data_type"), cl.text("ts_code", required=True), cl.text("ts_name"), cl.whole("rank"), cl.numbers(tt.RATIO, "pct_change"),
        cl.numbers(tt.PRICE, "current_price"), [cl.Out("concept", sc.json_list("concept"))], reason or cl.text("rank_reason"),
        cl.numbers(tt.SCORE, "hot"), [cl.Out("rank_time", F.col("_captured"), F.col("_captured").isNull(), "invalid rank_time")])


def _newest_capture(captured: DataFrame, scope: str) -> DataFrame:
    """The rows of each scope's newest complete capture; times are parsed once per distinct text, not per row."""
    keys = [scope, "trade_date"]
    times = captured.groupBy(*keys, "rank_time").agg(F.count("*").alias("_n")).withColumn(
        "_captured", sc.capture_time("rank_time", sc.strict_date("trade_date")))
    sizes = times.groupBy(*keys, "_captured").agg(F.sum("_n").alias("_size"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("_size", "_captured"))["_captured"].alias("_captured"))
    chosen = times.join(best, [*keys, "_captured"], "left_semi").select(
        *[F.col(c).alias(f"_{c}") for c in keys], F.col("rank_time").alias("_time"), "_captured")
    same = [F.col(c) == F.col(f"_{c}") for c in keys]
    return captured.join(chosen, [*same, F.col("rank_time").eqNullSafe(F.col("_time"))]).select(*captured.columns, "_captured")


def stock_hot_rank_daily(
    ordered: DataFrame | None, captured: DataFrame | None, stock_master: DataFrame, business_date: Column | None = None,
    *, scope: str = "scope_key", chunk_rows: int = 8192,
) -> Prepared:
    """Newest complete snapshot of each hot list.

    ``ordered`` is the feed without usable capture times per row: snapshots are cut where a
    code or rank repeats, in ``_ord`` order. ``captured`` groups rows by capture time; its
    rank type is the ``hot_type`` of the request scope.
    """
    parts = []
    if ordered is not None:
        ordered = ordered.withColumn("_captured", sc.capture_time("rank_time", sc.strict_date("trade_date")))
        segments = dd.segment_snapshots(ordered, [scope, "trade_date"], "_ord", "ts_code", "rank", chunk_rows=chunk_rows)
        newest = written(dd.latest_complete_segment(segments, [scope, "trade_date"], "_captured"), "hot-segments")
        parts.append(cl.usable(_hot_rows(newest, "THS", F.lit("FINAL"), business_date), "ths_hot"))
    if captured is not None:
        newest = written(_newest_capture(captured, scope), "hot-captures")
        parts.append(cl.usable(_hot_rows(newest, "DC", sc.scope_param(scope, "hot_type"), business_date), "dc_hot"))
    rows = reduce(lambda a, b: a.unionByName(b), [frame for frame, _ in parts])
    checks = [check for _, check in parts]
    scope_cols = ["source", "trade_date", "market_type", "rank_type"]
    kept, rejected = _listed(rows, stock_master)
    return Prepared(kept, [*checks, Check(lambda: dd.snapshot_duplicates(rows, scope_cols, "ts_code", "rank"), "hot_rank: snapshot not unique")], {"rejected": rejected})


TOP_LIST_MONEY = "amount l_sell l_buy l_amount net_amount float_values"
TOP_LIST_RATES = "close pct_change turnover_rate net_rate amount_rate"


def stock_top_list_daily(raw: DataFrame, stock_master: DataFrame, business_date: Column | None = None) -> Prepared:
    """Top list with repeated reports merged; keys in real conflict are quarantined and reported."""
    rows, ok = cl.usable(cl.cleaned(
        raw, cl.dated(business_date), cl.text("ts_code reason", required=True), cl.text("name"),
        cl.floats(f"{TOP_LIST_RATES} {TOP_LIST_MONEY}"), keep=["_ord"]), "top_list")
    rules = dd.MergeRules(["trade_date", "ts_code", "reason"], "_ord", free=["name"], money=TOP_LIST_MONEY.split(), rate=TOP_LIST_RATES.split())
    merged = dd.merge_compatible(rows, rules)
    types = {**{c: tt.RATIO for c in TOP_LIST_RATES.split()}, "close": tt.PRICE, **{c: tt.QUANTITY for c in TOP_LIST_MONEY.split()}}
    final = merged.where("status <> 'quarantined'").drop("status", "_ord").withColumns({c: F.col(c).cast(t) for c, t in types.items()})
    kept, rejected = _listed(final, stock_master)
    return Prepared(kept, [ok], {
        "rejected": rejected, "quarantined": lambda: merged.where("status = 'quarantined'").select(*rules.keys),
        "merged": lambda: merged.where("status = 'merged'").select(*rules.keys)})


def stock_top_inst_daily(raw: DataFrame, stock_master: DataFrame, business_date: Column | None = None) -> Prepared:
    """Institution detail has no natural key; a date is replaced as a whole."""
    rows, ok = cl.usable(cl.cleaned(
        raw, cl.dated(business_date), cl.text("ts_code exalter", required=True), cl.choice("side", (0, 1), number=True),
        cl.numbers(tt.QUANTITY, "buy sell net_buy"), cl.numbers(tt.RATIO, "buy_rate sell_rate"), cl.text("reason", required=True)), "top_inst")
    kept, rejected = _listed(rows, stock_master)
    return Prepared(kept, [ok], {"rejected": rejected})


def stock_limit_event_daily(raw: DataFrame, stock_master: DataFrame, business_date: Column | None = None) -> Prepared:
    """Limit events; amounts keep the provider's unit under ``*_raw`` names."""
    out = _simple(
        raw, "stock_limit_event_daily", ["trade_date", "ts_code", "limit_type"], cl.dated(business_date), cl.text("ts_code", required=True),
        cl.choice("limit_type", ("U", "D", "Z"), source="limit"), cl.text("industry name up_stat"), cl.numbers(tt.PRICE, "close"),
        cl.numbers(tt.RATIO, "pct_chg turnover_ratio"),
        cl.numbers(tt.QUANTITY, amount_raw="amount", limit_amount_raw="limit_amount", float_mv_raw="float_mv", total_mv_raw="total_mv", fd_amount_raw="fd_amount"),
        cl.clocks("first_time last_time"), cl.whole("open_times limit_times"))
    out.rows, out.reports["rejected"] = _listed(out.rows, stock_master)
    return out


def stock_limit_step_daily(raw: DataFrame, stock_master: DataFrame, business_date: Column | None = None) -> Prepared:
    steps = sc.exact_integer("nums")
    out = _simple(
        raw, "stock_limit_step_daily", KEY, cl.dated(business_date), cl.text("ts_code", required=True), cl.text("name"),
        [cl.Out("nums", steps, F.coalesce(steps <= 0, F.lit(True)), "invalid nums")])
    out.rows, out.reports["rejected"] = _listed(out.rows, stock_master)
    return out


# ---------------------------------------------------------------- registry

GLOBAL, DATE, MONTH = "GLOBAL", "DATE", "MONTH"
MERGE, UPSERT, REPLACE, ENTITY, PATCH, REPLACE_MONTH = (
    "MASTER_MERGE", "UPSERT_KEY", "REPLACE_DATE", "REPLACE_ENTITY", "PATCH_COLUMNS", "REPLACE_MONTH")


@dataclass(frozen=True)
class Dataset:
    """How a dataset is prepared, released and written."""

    name: str
    prepare: Callable[..., Prepared]
    scope: str
    strategy: str
    keys: tuple[str, ...]
    inputs: tuple[str, ...]

    def publish(self, target: DataFrame, stage: DataFrame, dates: DataFrame | None = None) -> DataFrame:
        """New target table. ``dates`` lists the dates being replaced, so an empty stage clears them."""
        if self.strategy in (MERGE, UPSERT):
            return pb.upsert(target, stage, self.keys)
        if self.strategy == PATCH:
            return pb.patch_columns(target, stage, self.keys, [c for c in stage.columns if c not in self.keys])
        if self.strategy == ENTITY:
            return pb.replace_slice(target, stage, F.col("source") == "THS")
        if self.strategy == REPLACE_MONTH:
            return pb.replace_month(target, stage, "index_code", "snapshot_date")
        return pb.replace_dates(target, stage, stage if dates is None else dates, "trade_date")


def _d(name: str, prepare: Callable[..., Prepared], scope: str, strategy: str, keys: str, inputs: str) -> Dataset:
    return Dataset(name, prepare, scope, strategy, tuple(keys.split()), tuple(inputs.split()))


_CODE_DAY = "ts_code trade_date"
DATASETS: dict[str, Dataset] = {d.name: d for d in (
    _d("trade_calendar", trade_calendar, GLOBAL, MERGE, "exchange cal_date", "trade_cal"),
    _d("stock", stock, GLOBAL, MERGE, "ts_code", "stock_basic"),
    _d("stock_company", stock_company, GLOBAL, MERGE, "ts_code", "stock_company"),
    _d("etf", etf, GLOBAL, MERGE, "ts_code", "etf_basic"),
    _d("etf_daily", etf_daily, DATE, REPLACE, _CODE_DAY, "fund_daily fund_adj"),
    _d("etf_share_size_daily", etf_share_size_daily, DATE, REPLACE, _CODE_DAY, "etf_share_size"),
    _d("stock_daily.core", stock_daily_core, DATE, REPLACE, _CODE_DAY, "daily daily_basic adj_factor"),
    _d("stock_daily.limit", stock_daily_limit, DATE, PATCH, _CODE_DAY, "stk_limit"),
    _d("stock_technical_daily", stock_technical_daily, DATE, REPLACE, _CODE_DAY, "stk_factor"),
    _d("stock_moneyflow_daily", stock_moneyflow_daily, DATE, REPLACE, _CODE_DAY, "moneyflow"),
    _d("stock_suspend_daily", stock_suspend_daily, DATE, REPLACE, "ts_code trade_date suspend_type", "suspend_d"),
    _d("concept_board", concept_board, GLOBAL, MERGE, "source ts_code", "ths_index"),
    _d("concept_board_daily", concept_board_daily, DATE, REPLACE, "source ts_code trade_date", "ths_daily"),
    _d("concept_board_member", concept_board_member, GLOBAL, ENTITY, "source ts_code con_code", "ths_member"),
    _d("theme_index", theme_index, GLOBAL, MERGE, "source ts_code", "ths_index"),
    _d("theme_index_daily", theme_index_daily, DATE, REPLACE, "source ts_code trade_date", "ths_daily"),
    _d("theme_index_member", theme_index_member, GLOBAL, ENTITY, "source ts_code con_code", "ths_member"),
    _d("stock_hot_rank_daily", stock_hot_rank_daily, DATE, REPLACE, "source trade_date market_type rank_type ts_code", "ths_hot dc_hot"),
    _d("market_theme_daily", market_theme_daily, DATE, UPSERT, "source theme_code trade_date", "dc_concept"),
    _d("market_theme_member_daily", market_theme_member_daily, DATE, REPLACE, "source trade_date theme_code ts_code", "dc_concept_cons"),
    _d("stock_top_list_daily", stock_top_list_daily, DATE, REPLACE, "trade_date ts_code reason", "top_list"),
    _d("stock_top_inst_daily", stock_top_inst_daily, DATE, REPLACE, "", "top_inst"),
    _d("stock_limit_event_daily", stock_limit_event_daily, DATE, REPLACE, "trade_date ts_code limit_type", "limit_list_d"),
    _d("stock_limit_step_daily", stock_limit_step_daily, DATE, REPLACE, "trade_date ts_code", "limit_step"),
    _d("ths_board_moneyflow_daily", ths_board_moneyflow_daily, DATE, REPLACE, "board_type trade_date board_name", "moneyflow_cnt_ths moneyflow_ind_ths"),
    _d("market_index", market_index, GLOBAL, MERGE, "ts_code", "index_basic"),
    _d("market_index_daily", market_index_daily, DATE, REPLACE, _CODE_DAY, "index_daily"),
    _d("index_daily_basic", index_daily_basic, DATE, REPLACE, _CODE_DAY, "index_dailybasic"),
    _d("market_index_weight", market_index_weight, MONTH, REPLACE_MONTH, "index_code snapshot_date con_code", "index_weight"),
)}
