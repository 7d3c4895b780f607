"""The operators' logical inputs over the star-schema tables: daily bars, daily closes by symbol, quotes, events.

Money is summed as DECIMAL and turned into DOUBLE once, so sums don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, open, high, low, close: orders of a day as its trades, in order of their keys."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice")
    return o.groupBy("d").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"))


def market_days(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """A row for each day from one scan of the orders: d, open, high, low, close, and the closes of some priorities as c0, c1, ..."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice", "o_orderpriority")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    own = [F.sum(F.when(F.col("o_orderpriority") == n, price.cast("decimal(18,2)"))).cast("double").alias(f"c{k}") for k, n in enumerate(names)]
    return o.groupBy("d").agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), *own)


def symbol_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, d, close: parts' brands by day of shipment."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sym"))
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("sym", "d").agg(_money("l_extendedprice").alias("close"))


def sector_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, d, close: orders' priorities by day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sym"), F.to_date("o_orderdate").alias("d")).agg(_money("o_totalprice").alias("close"))


def benchmark_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(_money("o_totalprice").alias("close"))


def region_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, type (region or style), d, close: customers' regions and segments by day. Orders meet customers once for both."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    who = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")
    days = orders.join(who, orders["o_custkey"] == who["c_custkey"]).groupBy("d", "r_name", "c_mktsegment").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("x"))
    both = days.select("d", "x", F.explode(F.array(F.struct(F.lit("region").alias("type"), F.col("r_name").alias("sym")), F.struct(F.lit("style").alias("type"), F.col("c_mktsegment").alias("sym")))).alias("k"))
    return both.groupBy("k.sym", "k.type", "d").agg(F.sum("x").cast("double").alias("close"))


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, y: a short daily ratio, one kind of event to another."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "event_type")
    days = e.groupBy("d").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return days.where("b > 0").select("d", (F.col("a") / F.col("b")).alias("y"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("calls"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, price, prev_close: each symbol's last two closes."""
    from ..operators.windows import tail

    last = tail(symbol_closes(spark, sf_dir), 2, ["sym"], "d")
    return last.groupBy("sym").agg(F.max_by("close", "d").alias("price"), F.when(F.count(F.lit(1)) > 1, F.min_by("close", "d")).alias("prev_close"))
