"""Market questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from tapeloom.functions.predicates import SCREEN_FIELDS, Catalogue, Field, Filter, Sort, Universe
from tapeloom.functions.scalar import first_named, json_safe
from tapeloom.operators.asof import gate, latest_joint
from tapeloom.plans import market as mk
from tapeloom.sources.views import Views

ALL = ["click", "view", "purchase", "signup", "error"]
PAIR = ["click", "purchase"]
CATALOGUE = Catalogue({**SCREEN_FIELDS, "stock.ts_code": Field("code", "string")})
FIELDS = ["stock.ts_code", "stock.name", "stock.industry", "market.close", "market.pct_chg", "market.amount",
          "technical.macd", "moneyflow.net_mf_amount"]


def joint(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return (f"SELECT trade_date FROM v_rel WHERE dataset IN ({listed}) GROUP BY trade_date "
            f"HAVING count(DISTINCT dataset) = {len(names)}")


def screen_sql(dates: str, where: str, order: str, limit: int, *, per_date: bool = False, halted: bool = True) -> str:
    anti = """ANTI JOIN (SELECT code, trade_date FROM v_suspend WHERE suspend_type = 'S') h
              ON h.code = p.code AND h.trade_date = p.trade_date""" if halted else ""
    part = "PARTITION BY p.trade_date " if per_date else ""
    return f"""
        SELECT trade_date, code, name, industry, CAST(close AS DOUBLE) AS close, CAST(pct_chg AS DOUBLE) AS pct_chg,
               CAST(amount AS DOUBLE) AS amount, CAST(macd AS DOUBLE) AS macd, CAST(net_mf_amount AS DOUBLE) AS net_mf_amount
        FROM (SELECT p.*, s.name, s.industry, t.macd, f.net_mf_amount,
                     row_number() OVER ({part}ORDER BY {order}, p.code) AS rn
              FROM (SELECT * FROM v_px WHERE trade_date IN ({dates})) p {anti}
              JOIN v_sec s ON s.code = p.code
              LEFT JOIN v_tech t ON t.code = p.code AND t.trade_date = p.trade_date
              LEFT JOIN v_flow f ON f.code = p.code AND f.trade_date = p.trade_date
              WHERE {where}) WHERE rn <= {limit}"""


def _screen(v: Views, **kw):
    return mk.screen(v.sec, v.px, v.tech, v.flow, v.rel, suspended=v.suspend, catalogue=CATALOGUE, fields=FIELDS, **kw)


@query("screen_all", screen_sql(
    f"SELECT max(trade_date) FROM ({joint(ALL)})",
    "s.list_status = 'L' AND p.close >= 5 AND p.pct_chg BETWEEN -90 AND 900 AND t.macd IS NOT NULL AND f.net_mf_amount <> 0",
    "p.amount DESC NULLS FIRST", 50))
def screen_all(v: Views):
    return _screen(v, datasets=ALL, sort=[Sort("market.amount")], filters=[
        Filter("market.close", "gte", 5), Filter("market.pct_chg", "between", [-90, 900]),
        Filter("technical.macd", "is_null", False), Filter("moneyflow.net_mf_amount", "ne", 0)])


@query("screen_any", screen_sql(
    f"SELECT max(trade_date) FROM ({joint(PAIR)})",
    "s.list_status = 'L' AND (p.close < 20 OR p.pct_chg > 100 OR s.industry IN ('BUILDING', 'MACHINERY'))",
    "p.pct_chg ASC NULLS LAST", 200))
def screen_any(v: Views):
    return _screen(v, datasets=PAIR, match="any", sort=[Sort("market.pct_chg", "asc")], limit=200, filters=[
        Filter("market.close", "lt", 20), Filter("market.pct_chg", "gt", 100),
        Filter("stock.industry", "in", ["BUILDING", "MACHINERY"])])


@query("screen_universe", screen_sql(
    f"SELECT max(trade_date) FROM ({joint(PAIR)})",
    "s.list_status IN ('L', 'D') AND s.exchange IN ('ASIA', 'EUROPE', 'AFRICA') AND s.industry IN ('HOUSEHOLD', 'FURNITURE', 'BUILDING')",
    "p.amount DESC NULLS FIRST", 200, halted=False))
def screen_universe(v: Views):
    return _screen(v, datasets=PAIR, sort=[Sort("market.amount")], limit=200, universe=Universe(
        list_status=("L", "D"), exchanges=("ASIA", "EUROPE", "AFRICA"), industries=("HOUSEHOLD", "FURNITURE", "BUILDING"),
        exclude_suspended=False))


@query("screen_excl_suspended", screen_sql(
    joint(PAIR), "s.list_status = 'L' AND p.close > p.low", "p.close DESC NULLS FIRST", 200, per_date=True).replace(
        "p.close > p.low", "p.close > 1"))
def screen_excl_suspended(v: Views):
    """Every released date at once, 200 stocks per date, halted stocks left out."""
    return _screen(v, datasets=PAIR, every_date=True, limit=200, sort=[Sort("market.close")],
                   filters=[Filter("market.close", "gt", 1)])


@query("search_multi", """
    WITH found AS (
      SELECT * FROM (SELECT 'stock' AS type, code, name, row_number() OVER (ORDER BY starts_with(lower(code), 'u1') DESC, starts_with(lower(name), 'u1') DESC, code) AS rn
        FROM v_sec WHERE contains(lower(code), 'u1') OR contains(lower(name), 'u1') OR contains(lower(industry), 'u1'))
      UNION ALL
      SELECT * FROM (SELECT 'index', topic, topic_name, row_number() OVER (ORDER BY starts_with(lower(topic), 'u1') DESC, topic)
        FROM v_topics WHERE contains(lower(topic), 'u1') OR contains(lower(topic_name), 'u1'))
      UNION ALL
      SELECT * FROM (SELECT 'etf', member, coalesce(nullif(name, ''), industry), row_number() OVER (ORDER BY starts_with(lower(member), 'u1') DESC, member)
        FROM v_parts WHERE contains(lower(member), 'u1') OR contains(lower(name), 'u1') OR contains(lower(kind), 'u1'))),
    scored AS (SELECT type, code, name, CASE WHEN lower(code) = 'u1' THEN 0 WHEN starts_with(lower(code), 'u1') THEN 1
                 WHEN starts_with(lower(name), 'u1') THEN 2 ELSE 3 END AS score FROM found WHERE rn <= 50)
    SELECT type, code, name, score FROM (SELECT *, row_number() OVER (ORDER BY score, lower(code), type) AS rn FROM scored) WHERE rn <= 50""")
def search_multi(v: Views):
    return mk.search_securities({
        "stock": mk.Searchable(v.sec, "code", F.col("name"), ["code", "name", "industry"], prefer=["name"]),
        "index": mk.Searchable(v.topics, "topic", F.col("topic_name"), ["topic", "topic_name"]),
        "etf": mk.Searchable(v.parts, "member", first_named("name", "industry"), ["member", "name", "kind"]),
    }, "U1", limit=50)


@query("snapshot", f"""
    SELECT p.code, p.trade_date, s.name, s.list_status, CAST(p.close AS DOUBLE) AS close, p.volume,
           CAST(t.close_qfq AS DOUBLE) AS close_qfq, CAST(f.net_mf_amount AS DOUBLE) AS net_mf_amount
    FROM v_sec s JOIN v_px p USING (code) JOIN v_tech t ON t.code = p.code AND t.trade_date = p.trade_date
    JOIN v_flow f ON f.code = p.code AND f.trade_date = p.trade_date
    WHERE p.trade_date = (SELECT max(trade_date) FROM ({joint(ALL)}))""")
def snapshot(v: Views):
    out = mk.stock_snapshot(v.sec, v.px, v.tech, v.flow, v.rel, datasets=ALL)
    return out.select("code", "trade_date", "profile.name", "profile.list_status", "quote.close", "quote.volume",
                      "technical.close_qfq", "moneyflow.net_mf_amount")


@query("hist_adjusted", f"""
    SELECT p.code, p.trade_date, CAST(t.open_qfq AS DOUBLE) AS open, CAST(t.high_qfq AS DOUBLE) AS high,
           CAST(t.low_qfq AS DOUBLE) AS low, CAST(t.close_qfq AS DOUBLE) AS close, CAST(t.pre_close_qfq AS DOUBLE) AS pre_close,
           CAST(t.close_qfq - t.pre_close_qfq AS DOUBLE) AS change, CAST(p.pct_chg AS DOUBLE) AS pct_chg, p.volume,
           CAST(p.amount AS DOUBLE) AS amount, f.net_mf_vol, CAST(f.net_mf_amount AS DOUBLE) AS net_mf_amount
    FROM v_px p JOIN v_tech t ON t.code = p.code AND t.trade_date = p.trade_date
    JOIN v_flow f ON f.code = p.code AND f.trade_date = p.trade_date
    WHERE p.trade_date IN ({joint(PAIR)})""")
def hist_adjusted(v: Views):
    return mk.stock_history(v.px, v.rel, datasets=PAIR, technical=v.tech, moneyflow=v.flow, adjustment="qfq", limit=None)


_HIST = """SELECT code, trade_date, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low,
    CAST(close AS DOUBLE) AS close, CAST(pre_close AS DOUBLE) AS pre_close, CAST(change AS DOUBLE) AS change,
    CAST(pct_chg AS DOUBLE) AS pct_chg, volume, CAST(amount AS DOUBLE) AS amount"""


@query("hist_release_gated", f"{_HIST} FROM v_px WHERE trade_date IN ({joint(ALL)})")
def hist_release_gated(v: Views):
    return mk.stock_history(v.px, v.rel, datasets=ALL, limit=None)


@query("hist_range", f"""{_HIST} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS rn FROM v_px
    WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND trade_date IN ({joint(["view"])})) WHERE rn <= 5""")
def hist_range(v: Views):
    return mk.stock_history(v.px, v.rel, datasets=["view"], start="2024-01-05", end="2024-01-25", order="asc", limit=5)


@query("ev_union", f"""
    WITH rows_ AS (
      SELECT 'hot_rank' AS section, code, trade_date, event_id, CAST(json_object('event_id', event_id, 'rank', rank, 'slot', slot) AS VARCHAR) AS payload
        FROM v_hot WHERE trade_date IN ({joint(["click"])})
      UNION ALL
      SELECT 'suspensions', code, trade_date, 0, CAST(json_object('suspend_type', suspend_type) AS VARCHAR)
        FROM v_suspend WHERE trade_date IN ({joint(["error"])})
      UNION ALL
      SELECT 'moneyflow', code, trade_date, 0, CAST(json_object('net_mf_vol', net_mf_vol) AS VARCHAR) FROM v_flow)
    SELECT section, code, trade_date, payload FROM (
      SELECT *, row_number() OVER (PARTITION BY section, code ORDER BY trade_date DESC, event_id) AS rn FROM rows_) WHERE rn <= 4""")
def ev_union(v: Views):
    return mk.stock_events(
        {"hot_rank": v.hot.select("code", "trade_date", "event_id", "rank", "slot"),
         "suspensions": v.suspend, "moneyflow": v.flow.select("code", "trade_date", "net_mf_vol")},
        v.rel, datasets={"hot_rank": "click", "suspensions": "error"}, limit_per_type=4, tie=["event_id"])


@query("ev_memberships", "SELECT topic, member, weight, topic_name, kind FROM v_mem JOIN v_topics USING (topic)")
def ev_memberships(v: Views):
    return mk.memberships(v.mem, v.topics, ["topic"])


_DATED = """SELECT event_type AS source, trade_date, slot AS theme, code, count(*) AS hot_num FROM v_hot GROUP BY ALL"""
_FACTS = """SELECT event_type AS source, trade_date, slot AS theme, CAST(max(score) AS DOUBLE) AS hot FROM v_hot
            GROUP BY ALL HAVING max(score) >= 100"""


def dated_members(v: Views):
    return v.hot.groupBy(F.col("event_type").alias("source"), "trade_date", F.col("slot").alias("theme"), "code").agg(
        F.count("*").alias("hot_num"))


def dated_themes(v: Views):
    return v.hot.groupBy(F.col("event_type").alias("source"), "trade_date", F.col("slot").alias("theme")).agg(
        F.max("score").alias("hot")).where("hot >= 100")


@query("ev_dated_topics", f"SELECT * FROM ({_DATED}) JOIN ({_FACTS}) USING (source, trade_date, theme)")
def ev_dated_topics(v: Views):
    return mk.memberships(dated_members(v), dated_themes(v), ["source", "trade_date", "theme"])


# ---------------------------------------------------------------- rankings


def ranked(inner: str, order: str, dataset: str, columns: str, limit: int) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {order}) AS rn
        FROM ({inner}) WHERE trade_date IN ({joint([dataset])})) WHERE rn <= {limit}"""


@query("rank_hot", ranked(
    "SELECT trade_date, event_type AS source, 'A' AS market_type, slot AS rank_type, code AS ts_code, min(event_id) AS rank FROM v_hot GROUP BY ALL",
    "source, market_type, rank_type, rank", "click", "trade_date, source, market_type, rank_type, ts_code, rank", 50))
def rank_hot(v: Views):
    rows = v.hot.groupBy("trade_date", F.col("event_type").alias("source"), F.lit("A").alias("market_type"),
                         F.col("slot").alias("rank_type"), F.col("code").alias("ts_code")).agg(F.min("event_id").alias("rank"))
    return mk.market_ranking("hot", rows, v.rel, dataset="click", every_date=True)


@query("rank_limit", ranked(
    "SELECT trade_date, code AS ts_code, volume AS limit_times, CAST(amount AS DOUBLE) AS fd_amount_raw FROM v_px WHERE pct_chg > 0",
    "limit_times DESC, fd_amount_raw DESC, ts_code", "purchase", "trade_date, ts_code, limit_times, fd_amount_raw", 50))
def rank_limit(v: Views):
    kind = F.when(F.col("pct_chg") > 0, "U").when(F.col("pct_chg") < 0, "D").otherwise("Z")
    rows = v.px.select("trade_date", F.col("code").alias("ts_code"), F.col("volume").alias("limit_times"),
                       F.col("amount").alias("fd_amount_raw"), kind.alias("limit_type"))
    return mk.market_ranking("limit", rows, v.rel, dataset="purchase", every_date=True,
                             where=F.col("limit_type") == "U").drop("limit_type")


@query("rank_steps", ranked("SELECT trade_date, code AS ts_code, volume AS nums FROM v_bars", "nums DESC, ts_code", "view",
                            "trade_date, ts_code, nums", 20))
def rank_steps(v: Views):
    rows = v.bars.select("trade_date", F.col("code").alias("ts_code"), F.col("volume").alias("nums"))
    return mk.market_ranking("limit_step", rows, v.rel, dataset="view", every_date=True, limit=20)


@query("rank_top_list", ranked("SELECT trade_date, code AS ts_code, CAST(net_mf_amount AS DOUBLE) AS net_amount FROM v_flow",
                               "net_amount DESC, ts_code", "error", "trade_date, ts_code, net_amount", 30))
def rank_top_list(v: Views):
    rows = v.flow.select("trade_date", F.col("code").alias("ts_code"), F.col("net_mf_amount").alias("net_amount"))
    return mk.market_ranking("top_list", rows, v.rel, dataset="error", every_date=True, limit=30)


@query("rank_board_flow", ranked(
    """SELECT trade_date, industry AS board_name, CAST(sum(net_mf_amount) AS DOUBLE) AS net_amount
       FROM v_flow JOIN v_sec USING (code) GROUP BY ALL""",
    "net_amount DESC, board_name", "signup", "trade_date, board_name, net_amount", 3))
def rank_board_flow(v: Views):
    rows = v.flow.join(v.sec, "code").groupBy("trade_date", F.col("industry").alias("board_name")).agg(
        F.sum("net_mf_amount").alias("net_amount"))
    return mk.market_ranking("board_moneyflow", rows, v.rel, dataset="signup", every_date=True, limit=3)


@query("rank_themes", f"""
    SELECT trade_date, rank, hot, theme_code FROM (
      SELECT trade_date, event_type AS theme_code, count(*) AS rank, CAST(max(score) AS DOUBLE) AS hot FROM v_hot GROUP BY ALL)
    WHERE trade_date = (SELECT max(trade_date) FROM ({joint(["view"])})) ORDER BY rank, hot DESC, theme_code LIMIT 4""")
def rank_themes(v: Views):
    rows = v.hot.groupBy("trade_date", F.col("event_type").alias("theme_code")).agg(
        F.count("*").alias("rank"), F.max("score").alias("hot"))
    return mk.market_ranking("market_theme", rows, v.rel, dataset="view", limit=4)


# ---------------------------------------------------------------- topics, assets, status


@query("topic_resolve", """
    WITH tagged AS (SELECT *, CASE WHEN topic = 'SUPPLIER#00000000' OR lower(topic_name) = 'supplier#00000000' THEN 0
        WHEN contains(lower(topic_name), 'supplier#00000000') THEN 1 END AS tier FROM v_topics),
    best AS (SELECT tier, count(*) AS hits FROM tagged WHERE tier IS NOT NULL GROUP BY tier ORDER BY tier LIMIT 1)
    SELECT tier, topic, topic_name, kind, hits, CASE WHEN hits = 1 THEN 'FOUND' ELSE 'AMBIGUOUS_IDENTIFIER' END AS outcome
    FROM tagged JOIN best USING (tier) ORDER BY CASE WHEN tier = 1 THEN topic_name END, topic LIMIT 6""")
def topic_resolve(v: Views):
    return mk.resolve_topic(v.topics, "supplier#00000000")


@query("topk_members", """SELECT topic, member, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, member) AS rn FROM v_mem) WHERE rn <= 25""")
def topk_members(v: Views):
    return mk.top_members(v.mem, limit=25)


@query("asset_snapshot", f"""
    SELECT b.code, b.trade_date, CAST(b.close AS DOUBLE) AS close, b.volume, CAST(f.net_mf_amount AS DOUBLE) AS total_size
    FROM v_bars b JOIN v_flow f ON f.code = b.code AND f.trade_date = b.trade_date WHERE b.trade_date IN ({joint(PAIR)})""")
def asset_snapshot(v: Views):
    sizes = v.flow.select("code", "trade_date", F.col("net_mf_amount").alias("total_size"))
    return mk.asset_snapshot(v.bars.select("code", "trade_date", "close", "volume"), sizes, v.rel, datasets=PAIR, every_date=True)


@query("asset_history", f"""SELECT code, trade_date, CAST(close AS DOUBLE) AS close FROM (
    SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM v_bars
    WHERE trade_date >= DATE '2024-01-03' AND trade_date IN ({joint(["click"])})) WHERE rn <= 10""")
def asset_history(v: Views):
    return mk.asset_history(v.bars.select("code", "trade_date", "close"), v.rel, dataset="click", start="2024-01-03", limit=10)


@query("asset_constituents", """
    WITH w AS (SELECT 'T' || l_suppkey AS index_code, 'P' || l_partkey AS con_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL),
    m AS (SELECT index_code, max(snapshot_date) AS snapshot_date FROM w WHERE snapshot_date <= DATE '2000-06-15' GROUP BY ALL)
    SELECT index_code, snapshot_date, con_code, weight, name, industry FROM (
      SELECT w.*, p.name, p.industry, row_number() OVER (PARTITION BY index_code ORDER BY weight DESC, con_code) AS rn
      FROM w JOIN m USING (index_code, snapshot_date) JOIN v_parts p ON p.member = w.con_code) WHERE rn <= 1000""")
def asset_constituents(v: Views):
    weights = v.table("lineitem").groupBy(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("index_code"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("snapshot_date"),
    ).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("weight"))
    return mk.constituents(weights, v.parts.select("member", "name", "industry"), F.lit("2000-06-15").cast("date"), stock_key="member", limit=1000)


@query("asset_constituents_released", """
    WITH w AS (SELECT 'T' || l_suppkey AS index_code, 'P' || l_partkey AS con_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL),
    r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS released FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 HAVING min(l_orderkey) % 3 = 0),
    m AS (SELECT index_code, max(snapshot_date) AS snapshot_date FROM w WHERE snapshot_date <= (SELECT max(released) FROM r) GROUP BY ALL)
    SELECT index_code, snapshot_date, con_code, weight, name, industry FROM w JOIN m USING (index_code, snapshot_date) JOIN v_parts p ON p.member = w.con_code""")
def asset_constituents_released(v: Views):
    """All members of each index's newest snapshot up to the newest released month."""
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    lines = v.table("lineitem")
    released = lines.where("l_shipdate IS NOT NULL").groupBy(month.alias("trade_date")).agg(F.min("l_orderkey").alias("least")).where("least % 3 = 0").select(
        F.lit("market_index_weight").alias("dataset"), "trade_date")
    weights = lines.groupBy(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("index_code"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"), month.alias("snapshot_date"),
    ).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("weight"))
    return mk.constituents(weights, v.parts.select("member", "name", "industry"), releases=released, stock_key="member", limit=None)


@query("data_status", """
    WITH asked AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'dividends']) AS dataset),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY trade_date DESC, published_at DESC) AS rn FROM v_rel) WHERE rn = 1)
    SELECT dataset, trade_date, row_count, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, version,
           CASE WHEN published_at IS NULL THEN 'never_published' ELSE 'published' END AS status
    FROM asked LEFT JOIN newest USING (dataset)""")
def data_status(v: Views):
    return mk.data_status(v.rel, [*ALL, "dividends"])


@query("out_envelope", """
    SELECT code, strftime(trade_date, '%Y-%m-%d') AS trade_date, CAST(close AS VARCHAR) AS close, volume, CAST(amount AS VARCHAR) AS amount FROM v_bars""")
def out_envelope(v: Views):
    rows = v.bars.select("code", "trade_date", "close", "volume", "amount")
    return rows.select(*json_safe(rows.schema))


_GATES = {"hot_rank": "click", "top_list": "view", "institutions": "purchase", "limit_events": "signup", "limit_steps": "click",
          "suspensions": "error", "market_themes": "view"}
_GATES_SQL = ", ".join(f"('{section}', '{dataset}')" for section, dataset in _GATES.items())


@query("ev_sections", f"""
    WITH themes AS (SELECT event_type AS source, trade_date, slot, max(score) AS top FROM v_hot GROUP BY ALL HAVING max(score) >= 100),
    picks AS (SELECT event_type AS source, trade_date, slot, code, count(*) AS hot_num FROM v_hot GROUP BY ALL),
    dated AS (
      SELECT 'hot_rank' AS section, code, trade_date, json_object('source', event_type, 'rank', rank, 'rank_time', slot) AS payload FROM v_hot
      UNION ALL SELECT 'top_list', code, trade_date, json_object('amount', CAST(floor(amount) AS BIGINT), 'reason', CASE WHEN pre_close IS NULL THEN NULL WHEN close > pre_close THEN 'up' ELSE 'down' END)
        FROM v_px WHERE volume >= 2
      UNION ALL SELECT 'institutions', code, trade_date, json_object('exalter', 'seat ' || k, 'side', k % 2, 'buy', CAST(floor(value) AS BIGINT)) FROM v_ticks WHERE event_type = 'purchase'
      UNION ALL SELECT 'limit_events', code, trade_date, json_object('limit_type', CASE WHEN k >= 50 THEN 'U' ELSE 'D' END, 'open_times', k) FROM v_ticks WHERE event_type = 'signup'
      UNION ALL SELECT 'limit_steps', code, trade_date, json_object('nums', volume) FROM v_bars
      UNION ALL SELECT 'suspensions', code, trade_date, json_object('suspend_type', suspend_type, 'suspend_timing', NULL) FROM v_suspend
      UNION ALL SELECT 'market_themes', code, trade_date, json_object('source', source, 'theme_code', slot, 'hot_num', hot_num) FROM picks JOIN themes USING (source, trade_date, slot)),
    standing AS (
      SELECT CASE kind WHEN 'N' THEN 'concepts' ELSE 'theme_indices' END AS section, member AS code, weight >= 1 AS is_current, topic_name,
             json_object('topic_code', topic, 'topic_name', topic_name, 'weight', CAST(floor(weight) AS BIGINT), 'is_current', weight >= 1) AS payload
      FROM v_mem JOIN v_topics USING (topic)),
    events_ AS (
      SELECT section, code, trade_date, NULL AS is_current, NULL AS topic_name, CAST(payload AS VARCHAR) AS payload FROM dated
        JOIN (VALUES {_GATES_SQL}) AS g(section, dataset) USING (section) WHERE (dataset, trade_date) IN (SELECT (dataset, trade_date) FROM v_rel)
      UNION ALL SELECT section, code, NULL, is_current, topic_name, CAST(payload AS VARCHAR) FROM standing)
    SELECT section, code, trade_date, payload FROM (
      SELECT *, row_number() OVER (PARTITION BY section, code ORDER BY trade_date DESC NULLS LAST, is_current DESC NULLS LAST, topic_name NULLS LAST, payload) AS rn FROM events_) WHERE rn <= 3""")
def ev_sections(v: Views):
    """The newest three rows of all nine sections of every code."""
    day = ["code", "trade_date"]
    whole = lambda c: F.floor(c).cast("bigint")
    bought, signed = v.ticks.where("event_type = 'purchase'"), v.ticks.where("event_type = 'signup'")
    edges = mk.memberships(v.mem, v.topics, ["topic"]).select(
        F.col("member").alias("code"), "kind", F.col("topic").alias("topic_code"), "topic_name", whole("weight").alias("weight"), (F.col("weight") >= 1).alias("is_current"))
    tables = {
        "hot_rank": v.hot.select(*day, F.col("event_type").alias("source"), "rank", F.col("slot").alias("rank_time")),
        "top_list": v.px.where("volume >= 2").select(
            *day, whole("amount").alias("amount"),
            F.when(F.col("pre_close").isNotNull(), F.when(F.col("close") > F.col("pre_close"), "up").otherwise("down")).alias("reason")),
        "institutions": bought.select(*day, F.concat(F.lit("seat "), "k").alias("exalter"), (F.col("k") % 2).alias("side"), whole("value").alias("buy")),
        "limit_events": signed.select(*day, F.when(F.col("k") >= 50, "U").otherwise("D").alias("limit_type"), F.col("k").alias("open_times")),
        "limit_steps": v.bars.select(*day, F.col("volume").alias("nums")),
        "suspensions": v.suspend.withColumn("suspend_timing", F.lit(None).cast("string")),
        "concepts": edges.where("kind = 'N'"), "theme_indices": edges.where("kind <> 'N'"),
        "market_themes": mk.memberships(dated_members(v), dated_themes(v), ["source", "trade_date", "theme"]).withColumnRenamed("theme", "theme_code")}
    return mk.event_sections(tables, v.rel, datasets=_GATES, limit_per_type=3, key="code")
