"""Ready jobs over tables: sums, joins on a key, top rows, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cents(column: str):
    """A money column in whole cents, so that sums don't depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def sum_by_key(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_returnflag").alias("key")).agg(
        F.sum(cents("l_extendedprice")).alias("sum_cents"), F.count(F.lit(1)).alias("n"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


def reduce_side_join(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with the number of their items: items are counted before they meet the orders."""
    counts = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return orders.select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("items"))


def _large(orders: DataFrame, price: float) -> DataFrame:
    return orders.where(F.col("o_totalprice") > price).select(F.col("o_custkey").alias("c_custkey"))


def semi_join(customer: DataFrame, orders: DataFrame, price: float) -> DataFrame:
    """Customers with an order above ``price``."""
    return customer.join(_large(orders, price), "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_join(customer: DataFrame, orders: DataFrame, price: float) -> DataFrame:
    """Customers without an order above ``price``."""
    return customer.join(_large(orders, price), "c_custkey", "left_anti").select("c_custkey", "c_name")


def top_k(orders: DataFrame, k: int) -> DataFrame:
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(k).select("o_orderkey", cents("o_totalprice").alias("price_cents"))


def events_by_hour(events: DataFrame) -> DataFrame:
    """Events by type in windows of an hour."""
    return events.groupBy(F.date_trunc("hour", F.col("ts")).alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def last_event_of_user(events: DataFrame) -> DataFrame:
    """The last event of each user: a maximum over structs, which is added up before the shuffle."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.event_type")


def ranked_brands(part: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` dearest parts of each brand."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return part.select("p_brand", "p_partkey", rank.alias("place")).where(F.col("place") <= most)
