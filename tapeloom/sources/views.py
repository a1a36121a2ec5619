"""Market- and run-log-shaped views over the generic tables of a data folder.

``events`` play quotes, hot lists, provider requests and job runs; ``customer`` the
security master; ``orders`` batches and processing runs; ``lineitem`` collection tasks,
dependencies and topic members. Every view covers its whole base table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom import types as tt
from tapeloom.functions.scalar import pct_change, price_change


def code_of(column: str) -> Column:
    return F.concat(F.lit("U"), F.col(column).cast("string"))


class Views:
    """Lazy views of one data folder; nothing is read until a view is used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------ quotes

    @cached_property
    def ticks(self) -> DataFrame:
        """Events with code, trade date, decimal price and the number inside ``props``."""
        return self.table("events").select(
            "event_id", "ts", code_of("user_id").alias("code"), F.to_date("ts").alias("trade_date"), "event_type",
            F.col("value").cast(tt.PRICE).alias("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self.ticks.groupBy("code", "trade_date").agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
            F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
            F.count("*").alias("volume"), F.sum("value").cast(tt.QUANTITY).alias("amount"),
        )

    @cached_property
    def px(self) -> DataFrame:
        """Bars with the previous close; a code has at most one bar per day."""
        by_day = Window.partitionBy("code").orderBy("trade_date")
        out = self.bars.withColumn("pre_close", F.lag("close").over(by_day))
        return out.withColumns({
            "change": price_change("close", "pre_close"), "pct_chg": pct_change("close", "pre_close")})

    @cached_property
    def tech(self) -> DataFrame:
        """Adjusted prices and an indicator, only for days with two or more ticks."""
        half = F.lit("0.5").cast("decimal(2,1)")
        base = self.px.where(F.col("volume") >= 2)
        return base.select(
            "code", "trade_date",
            *[(F.col(c) * half).cast(tt.PRICE).alias(f"{c}_qfq") for c in ("open", "high", "low", "close", "pre_close")],
            (F.col("high") - F.col("low")).cast(tt.PRICE).alias("macd"),
            F.col("close").alias("source_close"),
        )

    @cached_property
    def flow(self) -> DataFrame:
        signed = F.when(F.col("event_type") == "purchase", F.col("value")).when(
            F.col("event_type") == "error", -F.col("value"))
        return self.ticks.where(F.col("event_type").isin("purchase", "error")).groupBy("code", "trade_date").agg(
            F.sum(signed).cast(tt.QUANTITY).alias("net_mf_amount"),
            F.count_if(F.col("event_type") == "purchase").alias("net_mf_vol"),
        )

    @cached_property
    def suspend(self) -> DataFrame:
        """(code, day) with an error tick; the kind is S when the day's last error is heavy."""
        return self.ticks.where("event_type = 'error'").groupBy("code", "trade_date").agg(
            F.when(F.max_by("value", "event_id") >= 50, "S").otherwise("R").alias("suspend_type"))

    # ------------------------------------------------------------ masters

    @cached_property
    def sec(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            code_of("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"),
            F.col("r_name").alias("exchange"), F.col("n_name").alias("area"),
            F.when(F.col("c_acctbal") < 0, "D").otherwise("L").alias("list_status"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Retired code -> current code: delisted codes continue under the same number with N."""
        retired = self.sec.where("list_status = 'D'")
        return retired.select(F.col("code").alias("old_code"), F.concat(F.lit("N"), F.substring("code", 2, 30)).alias("new_code"))

    @cached_property
    def topics(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("topic"), F.col("s_name").alias("topic_name"),
            F.when(F.col("s_acctbal") < 0, "TH").otherwise("N").alias("kind"))

    @cached_property
    def mem(self) -> DataFrame:
        """Topic -> member with a percentage weight."""
        qty = F.sum(F.col("l_quantity").cast("decimal(18,2)"))
        edges = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(qty.alias("qty"))
        total = edges.groupBy("l_suppkey").agg(F.sum("qty").alias("total"))
        return edges.join(total, "l_suppkey").select(
            F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("topic"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("member"),
            F.round(F.col("qty").cast("double") * 100 / F.col("total").cast("double"), 6).alias("weight"))

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("member"),
            F.col("p_name").alias("name"), F.col("p_brand").alias("industry"), F.col("p_type").alias("kind"))

    @cached_property
    def hot(self) -> DataFrame:
        """Hot-list feed in delivery order; six-hour capture slots."""
        return self.ticks.select(
            "trade_date", "event_id", "code", F.col("k").alias("rank"), F.col("value").alias("score"),
            F.floor(F.hour("ts") / 6).cast("int").alias("slot"), "event_type", F.col("ts").alias("captured"))

    @cached_property
    def cal(self) -> DataFrame:
        """Exchange calendar over the span of the events, weekdays open."""
        span = self.table("events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
        days = F.explode(F.sequence(span.select("a").scalar(), span.select("b").scalar()))
        return self.table("region").select(F.col("r_name").alias("exchange"), days.alias("cal_date")).withColumn(
            "is_open", F.weekday("cal_date") < 5)

    # ------------------------------------------------------------ releases and run logs

    @cached_property
    def rel(self) -> DataFrame:
        """A dataset (event type) is released for a day when its closing reading is 20 or more."""
        return self.ticks.groupBy(F.col("event_type").alias("dataset"), "trade_date").agg(
            F.count("*").alias("row_count"), F.max("ts").alias("published_at"), F.max("event_id").alias("version"),
            F.max_by("k", "event_id").alias("_closing"),
        ).where("_closing >= 20").drop("_closing")

    @cached_property
    def release_log(self) -> DataFrame:
        """Every re-publication: one log row per (dataset, day, slot)."""
        return self.ticks.groupBy(
            F.col("event_type").alias("dataset"), "trade_date", F.floor(F.hour("ts") / 6).cast("int").alias("slot"),
        ).agg(F.count("*").alias("row_count"), F.max("ts").alias("published_at"), F.max("event_id").alias("version"))

    @cached_property
    def req(self) -> DataFrame:
        """Provider requests; the endpoint is the event type of the call."""
        value = F.col("value")
        return self.ticks.select(
            F.col("event_id").alias("request_id"), F.concat(F.lit("ep_"), "event_type").alias("endpoint"),
            F.col("ts").alias("requested_at"), F.when(F.col("k") < 10, "ERROR").otherwise("SUCCESS").alias("status"),
            (value * 10).cast("bigint").alias("duration_ms"), F.when(F.col("k") > 80, F.col("k")).otherwise(0).alias("wait_ms"),
            F.when(F.col("k") == 50, 0).otherwise(F.col("k")).alias("row_count"))

    @cached_property
    def bat(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING")
        return self.table("orders").select(
            F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("scheduled_at"), status.alias("batch_status"),
            F.to_date("o_orderdate").alias("business_date"), F.col("o_orderpriority").alias("batch_type"))

    @cached_property
    def tsk(self) -> DataFrame:
        """Collection tasks: endpoint by line number, scope by part."""
        status = F.when(F.col("l_returnflag") == "A", "SUCCESS").when(F.col("l_returnflag") == "N", "FAILED").otherwise("RETRY_WAIT")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("batch_id"), F.concat(F.lit("api"), F.col("l_linenumber").cast("string")).alias("task_name"),
            F.concat(F.lit("part="), F.col("l_partkey").cast("string")).alias("scope_key"), status.alias("status"),
            F.col("l_shipdate").alias("finished_at"))

    @cached_property
    def proc(self) -> DataFrame:
        """Processing runs: output dataset by priority, business date by week."""
        status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("QUEUED")
        return self.table("orders").select(
            F.col("o_orderkey").alias("process_id"), F.col("o_orderpriority").alias("task_name"),
            F.to_date(F.date_trunc("week", "o_orderdate")).alias("business_date"), status.alias("status"),
            F.col("o_orderdate").alias("queued_at"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 1 day")).alias("finished_at"),
            F.when(F.col("o_totalprice") > 400000, 0).otherwise(1).alias("priority"))

    @cached_property
    def dep(self) -> DataFrame:
        """Processing dependencies out of line items."""
        status = F.when(F.col("l_returnflag") == "A", "READY").when(F.col("l_returnflag") == "N", "WAITING").otherwise("MISSING")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("process_id"), F.concat(F.lit("api"), F.col("l_linenumber").cast("string")).alias("name"),
            F.concat(F.lit("part="), F.col("l_partkey").cast("string")).alias("scope"), status.alias("status"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("no asset for "), F.col("l_partkey").cast("string"))).alias("blocked_reason"))

    @cached_property
    def jobs(self) -> DataFrame:
        """Scheduled job executions; the job is the user, errors are failed runs."""
        status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("RUNNING")
        return self.ticks.select(
            F.col("event_id").alias("execution_id"), F.concat(F.lit("job_"), "code").alias("job_id"), status.alias("status"),
            F.col("ts").alias("created_at"), F.col("k"))
