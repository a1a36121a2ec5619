"""Declared raw schemas of the provider feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ALLOWED, RETRY, FORBIDDEN, UNSUPPORTED = "ALLOWED", "RETRY", "FORBIDDEN", "UNSUPPORTED"


@dataclass(frozen=True)
class Feed:
    """A provider feed: text, whole-number and double columns in declared order."""

    name: str
    columns: tuple[str, ...]
    text: frozenset[str]
    whole: frozenset[str]
    key: tuple[str, ...]
    row_cap: int
    paged: bool
    empty: str
    retention_months: int | None = None

    @property
    def schema(self) -> T.StructType:
        def dtype(name: str) -> T.DataType:
            if name in self.text:
                return T.StringType()
            return T.LongType() if name in self.whole else T.DoubleType()

        return T.StructType([T.StructField(c, dtype(c)) for c in self.columns])

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.text and c not in self.whole)


def _feed(
    name: str,
    columns: str,
    *,
    text: str | None = None,
    whole: str = "",
    numeric: str = "",
    key: str = "",
    cap: int = 10_000,
    paged: bool = False,
    empty: str = RETRY,
    retention_months: int | None = None,
) -> Feed:
    """``text`` lists the text columns; when omitted all but ``numeric``/``whole`` are text."""
    cols = tuple(columns.split())
    whole_set = frozenset(whole.split())
    texts = frozenset(text.split()) if text is not None else frozenset(cols) - whole_set - frozenset(numeric.split())
    return Feed(name, cols, texts, whole_set, tuple(key.split()), cap, paged, empty, retention_months)


_CODE_DAY = "ts_code trade_date"

# Feed names, column names and order, keys, row caps and empty policies.
_ALL = (
    _feed("trade_cal", "exchange cal_date is_open pretrade_date", whole="is_open", key="exchange cal_date"),
    _feed(
        "stock_basic",
        "ts_code symbol name area industry fullname enname cnspell market exchange curr_type "
        "list_status list_date delist_date is_hs act_name act_ent_type",
        key="ts_code", empty=ALLOWED,
    ),
    _feed(
        "stock_company",
        "ts_code com_name com_id exchange chairman manager secretary reg_capital setup_date province "
        "city introduction website email office employees main_business business_scope",
        numeric="reg_capital", whole="employees", key="ts_code", empty=ALLOWED,
    ),
    _feed(
        "etf_basic",
        "ts_code csname extname cname index_code index_name setup_date list_date list_status exchange "
        "mgr_name custod_name mgt_fee etf_type",
        numeric="mgt_fee", key="ts_code", empty=ALLOWED,
    ),
    _feed(
        "daily",
        "ts_code trade_date open high low close pre_close change pct_chg vol amount ah_vol ah_amount",
        text=_CODE_DAY, key=_CODE_DAY, cap=6_000,
    ),
    _feed(
        "daily_basic",
        "ts_code trade_date close turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm "
        "dv_ratio dv_ttm total_share float_share free_share total_mv circ_mv",
        text=_CODE_DAY, key=_CODE_DAY, cap=6_000,
    ),
    _feed("adj_factor", "ts_code trade_date adj_factor", text=_CODE_DAY, key=_CODE_DAY, cap=6_000),
    _feed(
        "stk_limit", "trade_date ts_code pre_close up_limit down_limit",
        text=_CODE_DAY, key=_CODE_DAY, cap=5_800, paged=True,
    ),
    _feed(
        "stk_factor",
        "ts_code trade_date open open_hfq open_qfq high high_hfq high_qfq low low_hfq low_qfq close "
        "close_hfq close_qfq pre_close pre_close_hfq pre_close_qfq change pct_change vol amount "
        "adj_factor macd_dif macd_dea macd kdj_k kdj_d kdj_j rsi_6 rsi_12 rsi_24 boll_upper boll_mid "
        "boll_lower cci",
        text=_CODE_DAY, key=_CODE_DAY,
    ),
    _feed(
        "moneyflow",
        "ts_code trade_date buy_sm_vol buy_sm_amount sell_sm_vol sell_sm_amount buy_md_vol "
        "buy_md_amount sell_md_vol sell_md_amount buy_lg_vol buy_lg_amount sell_lg_vol sell_lg_amount "
        "buy_elg_vol buy_elg_amount sell_elg_vol sell_elg_amount net_mf_vol net_mf_amount",
        text=_CODE_DAY, key=_CODE_DAY, cap=6_000,
    ),
    _feed(
        "suspend_d", "ts_code trade_date suspend_timing suspend_type",
        key="ts_code trade_date suspend_type", cap=5_000, empty=ALLOWED,
    ),
    _feed(
        "fund_daily", "ts_code trade_date open high low close pre_close change pct_chg vol amount",
        text=_CODE_DAY, key=_CODE_DAY, cap=5_000,
    ),
    _feed("fund_adj", "ts_code trade_date adj_factor", text=_CODE_DAY, key=_CODE_DAY, cap=2_000, paged=True),
    _feed(
        "etf_share_size", "ts_code trade_date etf_name total_share total_size nav close exchange",
        text="ts_code trade_date etf_name exchange", key=_CODE_DAY, cap=5_000,
    ),
    _feed(
        "ths_index", "ts_code name count exchange list_date type",
        whole="count", key="ts_code", empty=FORBIDDEN,
    ),
    _feed(
        "ths_member", "ts_code con_code con_name weight in_date out_date is_new",
        numeric="weight", key="ts_code con_code", cap=5_000, empty=ALLOWED,
    ),
    _feed(
        "ths_daily",
        "ts_code trade_date close open high low pre_close avg_price change pct_change vol "
        "turnover_rate total_mv float_mv",
        text=_CODE_DAY, key=_CODE_DAY, cap=3_000,
    ),
    _feed(
        "ths_hot",
        "trade_date data_type ts_code ts_name rank pct_change current_price concept rank_reason hot rank_time",
        numeric="pct_change current_price hot", whole="rank",
        key="trade_date data_type ts_code rank_time", cap=2_000, paged=True,
    ),
    _feed(
        "dc_hot",
        "trade_date data_type ts_code ts_name rank pct_change current_price hot concept rank_time",
        numeric="pct_change current_price hot", whole="rank", cap=2_000,
    ),
    _feed(
        "dc_concept",
        "theme_code trade_date name pct_change hot sort strength z_t_num main_change lead_stock "
        "lead_stock_code lead_stock_pct_change",
        text="theme_code trade_date name lead_stock lead_stock_code", whole="sort z_t_num",
        key="theme_code trade_date", cap=5_000, retention_months=3,
    ),
    _feed(
        "dc_concept_cons",
        "ts_code trade_date name theme_code industry_code industry reason hot_num",
        whole="hot_num", cap=3_000, paged=True, empty=ALLOWED,
    ),
    _feed(
        "top_list",
        "trade_date ts_code name close pct_change turnover_rate amount l_sell l_buy l_amount "
        "net_amount net_rate amount_rate float_values reason",
        text="trade_date ts_code name reason", empty=ALLOWED,
    ),
    _feed(
        "top_inst", "trade_date ts_code exalter side buy buy_rate sell sell_rate net_buy reason",
        text="trade_date ts_code exalter reason", whole="side", empty=ALLOWED,
    ),
    _feed(
        "limit_list_d",
        "trade_date ts_code industry name close pct_chg amount limit_amount float_mv total_mv "
        "turnover_ratio fd_amount first_time last_time open_times up_stat limit_times limit",
        text="trade_date ts_code industry name first_time last_time up_stat limit",
        whole="open_times limit_times", key="trade_date ts_code limit", cap=2_500, paged=True,
    ),
    _feed(
        "limit_step", "ts_code name trade_date nums",
        whole="nums", key="trade_date ts_code", cap=2_000, empty=ALLOWED,
    ),
    _feed(
        "moneyflow_cnt_ths",
        "trade_date ts_code name lead_stock close_price pct_change industry_index company_num "
        "pct_change_stock net_buy_amount net_sell_amount net_amount",
        text="trade_date ts_code name lead_stock", whole="company_num", key="trade_date name", cap=5_000,
    ),
    _feed(
        "moneyflow_ind_ths",
        "trade_date ts_code industry lead_stock close pct_change company_num pct_change_stock "
        "close_price net_buy_amount net_sell_amount net_amount",
        text="trade_date ts_code industry lead_stock", whole="company_num", key="trade_date ts_code", cap=5_000,
    ),
    _feed(
        "index_basic",
        "ts_code name fullname market publisher index_type category base_date base_point list_date "
        "weight_rule desc exp_date",
        numeric="base_point", key="ts_code", cap=8_000, paged=True, empty=ALLOWED,
    ),
    _feed(
        "index_daily", "ts_code trade_date close open high low pre_close change pct_chg vol amount",
        text=_CODE_DAY, key=_CODE_DAY, cap=1_000,
    ),
    _feed(
        "index_dailybasic",
        "ts_code trade_date total_mv float_mv total_share float_share free_share turnover_rate "
        "turnover_rate_f pe pe_ttm pb",
        text=_CODE_DAY, key=_CODE_DAY, cap=3_000,
    ),
    _feed(
        "index_weight", "index_code con_code trade_date weight",
        numeric="weight", key="index_code trade_date con_code", cap=5_000, empty=ALLOWED,
    ),
)

FEEDS: dict[str, Feed] = {feed.name: feed for feed in _ALL}
