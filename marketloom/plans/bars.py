"""Bars and panels derived from the star schema, and the same as SQL.

Bars of one instrument are bounded by its sessions, so windows per symbol hold a calendar's worth
of rows however many trades go into them; the trades themselves are pre-aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import table


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def ohlc(rows: DataFrame, keys: list[str | Column], price: str, order: str) -> DataFrame:
    """Open, high, low, close and volume of each group; open and close by the total order column."""
    return rows.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """symbol, ts, open, high, low, close, volume: orders by priority and day."""
    o = table(spark, d, "orders")
    return ohlc(o, [F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("ts")], "o_totalprice", "o_orderkey")


def hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    """symbol, session, time, open, ...: events by type and hour."""
    e = table(spark, d, "events")
    return ohlc(e, [F.col("event_type").alias("symbol"), F.to_date("ts").alias("session"), F.date_format("ts", "HH:00").alias("time")], "value", "event_id")


def month_panel(spark: SparkSession, d: str) -> DataFrame:
    """entity, month, value: order value by nation and month."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("c_nationkey").alias("entity"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def liquidity_panel(spark: SparkSession, d: str) -> DataFrame:
    """entity, date, value: shipped value by supplier and day."""
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))


_OHLC = "arg_min({p}, {o}) as open, max({p}) as high, min({p}) as low, arg_max({p}, {o}) as close, count(*) as volume"
BARS = f"bars as (select o_orderpriority as symbol, o_orderdate::date as ts, {_OHLC.format(p='o_totalprice', o='o_orderkey')} from orders group by 1, 2)"
HOURS = f"hours as (select event_type as symbol, ts::date as session, strftime(ts, '%H:00') as time, {_OHLC.format(p='value', o='event_id')} from events group by 1, 2, 3)"
MONTHS = "months as (select c_nationkey as entity, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2))::double as value from orders join customer on o_custkey = c_custkey group by 1, 2)"
LIQUID = "liquid as (select l_suppkey as entity, l_shipdate::date as date, sum(l_extendedprice::decimal(18,2))::double as value from lineitem group by 1, 2)"
