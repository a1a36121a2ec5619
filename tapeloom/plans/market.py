"""The market questions: search, snapshot, history, screener, events, rankings, topics, assets.

Each returns a lazy DataFrame. Dates that depend on releases are scalar subqueries inside
the plan; the eager forms that must raise an error read one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.errors import QueryError
from tapeloom.functions.predicates import (
    DEFAULT_SCREEN_FIELDS,
    MAX_FIELDS,
    Catalogue,
    Filter,
    Sort,
    Universe,
    date_range,
    prefix_match,
    text_match,
    universe_predicate,
)
from tapeloom.functions.scalar import adjusted_columns
from tapeloom.operators.asof import asof_snapshot, gate, latest_joint
from tapeloom.operators.ranking import clamp, latest_per_key, row_limit, top_k_or_all
from tapeloom.operators.sets import union_tagged

# ---------------------------------------------------------------- search


@dataclass(frozen=True)
class Searchable:
    """A searchable master: its code and display-name columns and the columns matched."""

    frame: DataFrame
    code: str
    name: Column
    columns: Sequence[str]
    extra: Sequence[str] = ()
    prefer: Sequence[str] = ()  # columns whose prefix hit ranks first, after the code


def search_securities(masters: Mapping[str, Searchable], keyword: str, limit: int = 20) -> DataFrame:
    """Case-insensitive search over several masters, best matches first.

    Each master contributes at most ``limit`` rows (its own top-k) before the union is
    ranked again: exact code, code prefix, name prefix, other.
    """
    term = keyword.strip()
    if not term or len(term) > 128:
        raise QueryError("INVALID_REQUEST", "keyword must have 1 to 128 characters")
    limit = clamp(limit, 1, 50)
    parts = {}
    for kind, m in masters.items():
        order = [prefix_match(term, c).desc() for c in (m.code, *m.prefer)]
        found = m.frame.where(text_match(term, *m.columns)).orderBy(*order, F.col(m.code).asc()).limit(limit)
        parts[kind] = found.select(F.col(m.code).alias("code"), m.name.alias("name"), *m.extra)
    low, needle = F.lower(F.coalesce("code", F.lit(""))), F.lower(F.lit(term))
    score = (
        F.when(low == needle, 0).when(F.startswith(low, needle), 1)
        .when(F.startswith(F.lower(F.coalesce("name", F.lit(""))), needle), 2).otherwise(3)
    )
    return union_tagged(parts, "type").withColumn("score", score).orderBy("score", low, "type").limit(limit)


# ---------------------------------------------------------------- one-date and dated questions


def on_date(facts: DataFrame, resolved: Column, day: str = "trade_date") -> DataFrame:
    return facts.where(F.col(day) == resolved)


def stock_snapshot(
    stock: DataFrame, core: DataFrame, technical: DataFrame, moneyflow: DataFrame, releases: DataFrame, *,
    datasets: Sequence[str], company: DataFrame | None = None, requested: str | None = None,
    code: str | None = None, key: str = "code", day: str = "trade_date",
) -> DataFrame:
    """Profile, quote, technical and money flow of one code, or of every code, on one date."""
    resolved = latest_joint(releases, datasets, requested)
    parts = {"quote": core, "technical": technical, "moneyflow": moneyflow}
    profile = stock if company is None else stock.join(company, key, "left")
    out = profile.select(key, F.struct(*[c for c in profile.columns if c != key]).alias("profile"))
    if code is not None:
        out = out.where(F.col(key) == F.lit(code.upper()))
    for name, facts in parts.items():
        side = on_date(facts, resolved).select(
            key, day, F.struct(*[c for c in facts.columns if c not in (key, day)]).alias(name))
        out = out.join(side, key if name == "quote" else [key, day])
    return out


def stock_history(
    core: DataFrame, releases: DataFrame, *, datasets: Sequence[str], technical: DataFrame | None = None,
    moneyflow: DataFrame | None = None, adjustment: str = "raw", code: str | None = None,
    start: str | None = None, end: str | None = None, order: str = "desc", limit: int | None = 250,
    extra: Sequence[str] = ("pct_chg", "volume", "amount"), flow_columns: Sequence[str] = ("net_mf_vol", "net_mf_amount"),
    key: str = "code", day: str = "trade_date",
) -> DataFrame:
    """Released history with raw or adjusted prices; ``limit`` applies to each code, None gives all days.

    For one code the limit is held within 1,000, as the question's contract has it; the form over all codes takes any.
    """
    if adjustment not in ("raw", "qfq", "hfq") or order not in ("asc", "desc"):
        raise QueryError("INVALID_REQUEST", "unknown adjustment or order")
    limit = row_limit(limit, 1000, single=code is not None)
    picked = date_range(day, start, end)
    rows = core.where(picked if code is None else picked & (F.col(key) == F.lit(code.upper())))
    prices = adjusted_columns(adjustment)
    columns = list(extra)
    if adjustment != "raw":
        if technical is None:
            raise QueryError("INVALID_REQUEST", "adjusted prices need the technical table")
        wanted = [f"{n}_{adjustment}" for n in ("open", "high", "low", "close", "pre_close")]
        rows = rows.join(technical.select(key, day, *wanted), [key, day])
    if moneyflow is not None:
        rows = rows.join(moneyflow.select(key, day, *flow_columns), [key, day])
        columns += list(flow_columns)
    rows = gate(rows, releases, datasets).select(key, day, *[c.alias(n) for n, c in prices.items()], *columns)
    by_day = F.col(day).asc() if order == "asc" else F.col(day).desc()
    return top_k_or_all(rows, [key], [by_day], limit)


def screen_frame(stock: DataFrame, core: DataFrame, technical: DataFrame, moneyflow: DataFrame, *, key: str = "code", day: str = "trade_date") -> DataFrame:
    """Master with quotes, and technical and flow columns where they exist."""
    return (
        stock.join(core, key).join(technical, [key, day], "left").join(moneyflow, [key, day], "left")
    )


def screen(
    stock: DataFrame, core: DataFrame, technical: DataFrame, moneyflow: DataFrame, releases: DataFrame, *,
    datasets: Sequence[str], filters: Sequence[Filter] = (), match: str = "all", universe: Universe | None = None,
    fields: Sequence[str] = DEFAULT_SCREEN_FIELDS, sort: Sequence[Sort] = (), requested: str | None = None,
    limit: int | None = 50, suspended: DataFrame | None = None, catalogue: Catalogue | None = None,
    every_date: bool = False, key: str = "code", day: str = "trade_date",
) -> DataFrame:
    """Stocks of one released date that satisfy the filters, sorted, top ``limit``.

    ``every_date`` screens all released dates at once, with the limit per date.
    """
    catalogue = catalogue or Catalogue()
    universe = universe or Universe()
    names = list(dict.fromkeys(fields))
    if len(names) > MAX_FIELDS:
        raise QueryError("INVALID_REQUEST", "too many fields")
    predicate = catalogue.combine(filters, match)
    order = catalogue.ordering(sort) or [F.col("total_mv").desc_nulls_first()]
    columns = [catalogue.column(n).alias(catalogue.fields[n].column) for n in names]
    if every_date:
        quotes = gate(core, releases, datasets)
    else:
        quotes = on_date(core, latest_joint(releases, datasets, requested))
    listed = stock.where(universe_predicate(universe))
    if universe.exclude_suspended and suspended is not None:
        halted = suspended.where("suspend_type = 'S'").select(key, day)
        quotes = quotes.join(halted, [key, day], "left_anti")
    rows = screen_frame(listed, quotes, technical, moneyflow, key=key, day=day).where(predicate)
    ordering = [*order, F.col(key).asc()]
    if every_date:
        kept = top_k_or_all(rows, [day], ordering, row_limit(limit, 200, single=False))
        return kept.select(day, *columns)
    ranked = rows.orderBy(*ordering)
    return (ranked if limit is None else ranked.limit(clamp(limit, 1, 200))).select(day, *columns)


# ---------------------------------------------------------------- events


def stock_events(
    sections: Mapping[str, DataFrame], releases: DataFrame | None, *, datasets: Mapping[str, str] | None = None,
    code: str | None = None, start: str | None = None, end: str | None = None, limit_per_type: int | None = 50,
    key: str = "code", day: str = "trade_date", tie: Sequence[str] = (),
) -> DataFrame:
    """Latest ``limit_per_type`` rows (None: all) of every section per code, in one long frame.

    Dated sections are gated on their own dataset's releases; section columns are packed
    into JSON, so sections with different columns share one schema.
    """
    k = row_limit(limit_per_type, 200, single=code is not None)
    parts = {}
    for name, rows in sections.items():
        if code is not None:
            rows = rows.where(F.col(key) == F.lit(code.upper()))
        rows = rows.where(date_range(day, start, end))
        if releases is not None and datasets is not None and name in datasets:
            rows = gate(rows, releases, [datasets[name]])
        body = [c for c in rows.columns if c not in (key, day)]
        order = [F.col(day).desc(), *[F.col(c) for c in tie if c in rows.columns]]
        parts[name] = top_k_or_all(rows, [key], order, k).select(key, day, F.to_json(F.struct(*body)).alias("payload"))
    return union_tagged(parts, "section")


class Section(NamedTuple):
    """A kind of event: its dataset (None: standing memberships, which have no day) and the fields of its payload."""
    dataset: str | None
    fields: str


# The nine sections of a stock's events.
EVENT_SECTIONS: dict[str, Section] = {
    "hot_rank": Section(
        "stock_hot_rank_daily", "source market_type rank_type rank pct_change current_price concept rank_reason hot rank_time"),
    "top_list": Section(
        "stock_top_list_daily", "close pct_change turnover_rate amount l_sell l_buy net_amount net_rate reason"),
    "institutions": Section("stock_top_inst_daily", "exalter side buy buy_rate sell sell_rate net_buy reason"),
    "limit_events": Section(
        "stock_limit_event_daily", "limit_type name industry close pct_chg amount_raw limit_amount_raw turnover_ratio fd_amount_raw "
        "first_time last_time open_times up_stat limit_times"),
    "limit_steps": Section("stock_limit_step_daily", "name nums"),
    "suspensions": Section("stock_suspend_daily", "suspend_type suspend_timing"),
    "concepts": Section(None, "source topic_code topic_name weight in_date out_date is_current"),
    "theme_indices": Section(None, "source topic_code topic_name weight in_date out_date is_current"),
    "market_themes": Section("market_theme_member_daily", "source theme_code topic_name industry reason hot_num"),
}


def event_sections(
    tables: Mapping[str, DataFrame], releases: DataFrame, *, code: str | None = None, start: str | None = None, end: str | None = None,
    limit_per_type: int | None = 50, datasets: Mapping[str, str] | None = None, key: str = "ts_code", day: str = "trade_date",
) -> DataFrame:
    """The newest ``limit_per_type`` rows (None: all) of every section of ``EVENT_SECTIONS`` per code: section, code, day, payload.

    All sections are one union with their fields packed as JSON (nulls kept, fields that a table lacks left out), so that the
    question costs one join with the releases and one window however many sections there are. Dated rows count on days on
    which their section's dataset (``datasets`` may rename it) is released, within the range, newest first; memberships have no
    day and no range, current ones first, then by name. Equal rows follow their payload's text.

    Packed rows are several times as wide as what they are packed from, so they are dealt out anew by their size before any is
    sorted: a task sorts a bounded share, and rows of one key are trimmed in many tasks.
    """
    strange = sorted(set(tables) - set(EVENT_SECTIONS))
    if strange or not tables:
        raise QueryError("INVALID_REQUEST", "unknown or no event sections", sections=strange)
    k = row_limit(limit_per_type, 200, single=code is not None)
    names = datasets or {}
    dated: dict[str, DataFrame] = {}
    standing: dict[str, DataFrame] = {}
    for name, rows in tables.items():
        dataset, fields = EVENT_SECTIONS[name]
        if code is not None:
            rows = rows.where(F.col(key) == F.lit(code.upper()))
        body = F.struct(*[f for f in fields.split() if f in rows.columns])
        payload = F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")
        if dataset is None:
            standing[name] = rows.select(
                key, F.lit(None).cast("date").alias(day), payload, F.col("is_current").alias("_current"), F.col("topic_name").alias("_name"))
        else:
            dated[name] = rows.select(
                key, day, payload, F.lit(None).cast("boolean").alias("_current"), F.lit(None).cast("string").alias("_name"),
                F.lit(names.get(name, dataset)).alias("_dataset"))
    parts = []
    if dated:
        released = releases.select(F.col("dataset").alias("_dataset"), day).distinct()
        within = date_range(day, start, end)
        parts.append(union_tagged(dated, "section").where(within).join(released, ["_dataset", day], "left_semi").drop("_dataset"))
    if standing:
        parts.append(union_tagged(standing, "section"))
    events = reduce(lambda a, b: a.unionByName(b), parts).hint("rebalance", "section", key, day, "payload")
    order = [F.col(day).desc_nulls_last(), F.col("_current").desc_nulls_last(), F.col("_name").asc_nulls_last(), F.col("payload")]
    return top_k_or_all(events, ["section", key], order, k).select("section", key, day, "payload")


def memberships(members: DataFrame, topics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Membership edges with the topic's name, on the full topic key."""
    return members.join(topics, list(keys))


# ---------------------------------------------------------------- rankings

# Sort keys of the six rankings (column, descending).
RANKING_ORDER: dict[str, tuple[tuple[str, bool], ...]] = {
    "hot": (("source", False), ("market_type", False), ("rank_type", False), ("rank", False)),
    "limit": (("limit_times", True), ("fd_amount_raw", True), ("ts_code", False)),
    "limit_step": (("nums", True), ("ts_code", False)),
    "top_list": (("net_amount", True), ("ts_code", False)),
    "board_moneyflow": (("net_amount", True), ("board_name", False)),
    "market_theme": (("rank", False), ("hot", True), ("theme_code", False)),
}
RANKING_DATASET = {
    "hot": "stock_hot_rank_daily", "limit": "stock_limit_event_daily", "limit_step": "stock_limit_step_daily",
    "top_list": "stock_top_list_daily", "board_moneyflow": "ths_board_moneyflow_daily",
    "market_theme": "market_theme_daily",
}


def ranking_order(kind: str) -> list[Column]:
    if kind not in RANKING_ORDER:
        raise QueryError("INVALID_REQUEST", "unknown ranking", kind=kind)
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in RANKING_ORDER[kind]]


def market_ranking(
    kind: str, facts: DataFrame, releases: DataFrame, *, requested: str | None = None, where: Column | None = None,
    limit: int | None = 50, dataset: str | None = None, day: str = "trade_date", every_date: bool = False,
) -> DataFrame:
    """A ranking of one released date, or of every released date with the limit per date (None: whole rankings)."""
    name = dataset or RANKING_DATASET[kind]
    order, limit = ranking_order(kind), row_limit(limit, 200, single=not every_date)
    rows = facts if where is None else facts.where(where)
    if every_date:
        return top_k_or_all(gate(rows, releases, [name]), [day], order, limit)
    ranked = on_date(rows, latest_joint(releases, [name], requested), day).orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


# ---------------------------------------------------------------- topics


def resolve_topic(topics: DataFrame, identifier: str, *, code: str = "topic", name: str = "topic_name", limit: int = 6) -> DataFrame:
    """Candidates for a topic: exact code or name, otherwise names containing the text.

    ``outcome`` is FOUND, AMBIGUOUS_IDENTIFIER or (no rows) NOT_FOUND.
    """
    text = identifier.strip()
    if not text or len(text) > 128:
        raise QueryError("INVALID_REQUEST", "identifier must have 1 to 128 characters")
    exact = (F.col(code) == F.lit(text.upper())) | (F.lower(name) == F.lower(F.lit(text)))
    tagged = topics.withColumn("tier", F.when(exact, 0).when(text_match(text, name), 1)).where("tier IS NOT NULL")
    best = tagged.groupBy("tier").agg(F.count("*").alias("hits")).orderBy("tier").limit(1)
    return (
        tagged.join(best, "tier").orderBy(F.when(F.col("tier") == 1, F.col(name)), code).limit(limit)
        .withColumn("outcome", F.when(F.col("hits") == 1, "FOUND").otherwise("AMBIGUOUS_IDENTIFIER"))
    )


def require_topic(topics: DataFrame, identifier: str, **columns: str) -> dict:
    """Resolve a topic to one row or raise (reads at most six rows)."""
    rows = resolve_topic(topics, identifier, **columns).collect()
    if not rows:
        raise QueryError("NOT_FOUND", "no such topic", identifier=identifier)
    if len(rows) > 1:
        raise QueryError("AMBIGUOUS_IDENTIFIER", "several topics match", identifier=identifier, candidates=rows)
    return rows[0].asDict()


def top_members(members: DataFrame, *, topic: str = "topic", member: str = "member", weight: str = "weight", limit: int | None = 200, historical: bool = False) -> DataFrame:
    """Heaviest members of every topic (None: all of them); none for a historical date, as only the current list is kept."""
    rows = members.where(F.lit(False)) if historical else members
    return top_k_or_all(rows, [topic], [F.col(weight).desc_nulls_first(), F.col(member).asc()], row_limit(limit, 500, single=False))


# ---------------------------------------------------------------- index and ETF


def asset_snapshot(bars: DataFrame, sizes: DataFrame, releases: DataFrame, *, datasets: Sequence[str], requested: str | None = None, every_date: bool = False, key: str = "code", day: str = "trade_date") -> DataFrame:
    """Bars with their share size or valuation of the same date."""
    picked = gate(bars, releases, datasets) if every_date else on_date(bars, latest_joint(releases, datasets, requested), day)
    return picked.join(sizes, [key, day])


def asset_history(bars: DataFrame, releases: DataFrame, *, dataset: str, start: str | None = None, end: str | None = None, limit: int | None = 250, key: str = "code", day: str = "trade_date") -> DataFrame:
    """Released bars of every code, newest first, ``limit`` per code (None: all days)."""
    rows = gate(bars.where(date_range(day, start, end)), releases, [dataset])
    return top_k_or_all(rows, [key], [F.col(day).desc()], row_limit(limit, 1000, single=False))


def constituents(
    weights: DataFrame, stocks: DataFrame, through: Column | None = None, *, releases: DataFrame | None = None, dataset: str = "market_index_weight",
    requested: str | None = None, index: str = "index_code", snapshot: str = "snapshot_date", member: str = "con_code", stock_key: str = "ts_code",
    limit: int | None = 250,
) -> DataFrame:
    """Members of each index's newest snapshot, heaviest first, ``limit`` per index (None: all members).

    With ``releases`` (dataset, trade_date = first day of a released month) the snapshot must not lie after the newest month of
    ``dataset`` released at or before ``requested``; otherwise, or besides, it must not be after ``through``.
    """
    rows = weights
    if releases is not None:
        asked = releases if requested is None else releases.where(F.col("trade_date") <= F.lit(requested).cast("date"))
        month = latest_joint(asked, [dataset])
        rows = rows.where(F.trunc(snapshot, "MM") <= F.trunc(month, "MM"))
        through = F.last_day(month) if through is None else F.least(through, F.last_day(month))
    if through is None:
        raise QueryError("INVALID_REQUEST", "a date or releases are needed")
    newest = asof_snapshot(rows, [index], snapshot, through)
    named = newest.join(stocks.withColumnRenamed(stock_key, member), member)
    return top_k_or_all(named, [index], [F.col("weight").desc_nulls_first(), F.col(member).asc()], row_limit(limit, 1000, single=False))


# ---------------------------------------------------------------- status


def data_status(releases: DataFrame, requested: Sequence[str] = (), *, dataset: str = "dataset", day: str = "trade_date") -> DataFrame:
    """Latest release of each dataset; requested names without one are ``never_published``."""
    if len(requested) > 50:
        raise QueryError("INVALID_REQUEST", "too many datasets")
    newest = latest_per_key(releases, [dataset], [F.col(day).desc_nulls_first(), F.col("published_at").desc_nulls_first()])
    if requested:
        names = list(dict.fromkeys(requested))
        asked = releases.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(dataset))
        newest = asked.join(newest, dataset, "left")
    return newest.withColumn("status", F.when(F.col("published_at").isNull(), "never_published").otherwise("published"))


def require_known(releases: DataFrame, requested: Sequence[str], dataset: str = "dataset") -> None:
    """Raise for dataset names that have never been released (reads at most 50 rows)."""
    known = {r[0] for r in releases.where(F.col(dataset).isin(*requested)).select(dataset).distinct().collect()}
    unknown = sorted(set(requested) - known)
    if unknown:
        raise QueryError("UNKNOWN_DATASET", "unknown datasets", datasets=unknown)
