"""Dated charges of orders, their monthly sums and net returns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTIONAL = 10_000_000.0
TOP, LOW, TOP_PLACE, LOW_PLACE = "1-5", "6-10", 5, 10
#: Slippage in basis points of the first and of the other band, by scenario.
SLIPPAGE_BPS = {"S0": (0, 0), "S1": (5, 10), "S2": (10, 20), "S3": (20, 40), "S4": (40, 80)}
COMPONENTS = ("stt_buy", "stt_sell", "stamp_duty_buy", "exchange_txn", "sebi_fee", "brokerage", "indirect_tax", "dp_charge")
#: component, since, until, rate (of dp_charge the amount), cap an order.
PERIODS = (
    ("stt_buy", "1990-01-01", "1997-12-31", 0.001, None),
    ("stt_buy", "1998-01-01", "2099-12-31", 0.00125, None),
    ("stt_sell", "1990-01-01", "1997-12-31", 0.001, None),
    ("stt_sell", "1998-01-01", "2099-12-31", 0.00125, None),
    ("stamp_duty_buy", "1990-01-01", "2099-12-31", 0.00015, None),
    ("exchange_txn", "1990-01-01", "1999-06-30", 0.0000345, None),
    ("exchange_txn", "1999-07-01", "2099-12-31", 0.0000325, None),
    ("sebi_fee", "1990-01-01", "2099-12-31", 0.000001, None),
    ("brokerage", "1990-01-01", "2099-12-31", 0.001, 20.0),
    ("indirect_tax", "1990-01-01", "1996-12-31", 0.12, None),
    ("indirect_tax", "1997-01-01", "2099-12-31", 0.18, None),
    ("dp_charge", "1990-01-01", "2099-12-31", 15.34, None),
)
SCHEDULE_SQL = "schedule as (select * from (values " + ", ".join(f"('{c}', date '{a}', date '{b}', {r!r}::double, {'null' if m is None else repr(m)}::double)" for c, a, b, r, m in PERIODS) + ") v(component, since, until, rate, cap))"


def schedule(spark: SparkSession) -> DataFrame:
    """component, since, until, rate, cap: the dated charges, days inclusive."""
    rows = [(c, date.fromisoformat(a), date.fromisoformat(b), r, m) for c, a, b, r, m in PERIODS]
    return spark.createDataFrame(rows, "component string, since date, until date, rate double, cap double")


def charges_on(days: DataFrame, periods: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(s_plus, <component>, brokerage_cap): the one rate of every component in force on each day; raises if none or several are.

    One row per trading day, found over the days (a calendar) and the schedule, not over orders.
    """
    d = days.select("s_plus").distinct()
    hit = d.join(periods, (d.s_plus >= periods.since) & (d.s_plus <= periods.until))
    per = hit.groupBy("s_plus").agg(
        *[F.count_if(F.col("component") == c).alias(f"_n_{c}") for c in components],
        *[F.max(F.when(F.col("component") == c, F.col("rate"))).alias(c) for c in components],
        F.max(F.when(F.col("component") == "brokerage", F.col("cap"))).alias("brokerage_cap"),
    )
    full = d.join(per, "s_plus", "left")
    one = F.lit(True)
    for c in components:
        one = one & F.coalesce(F.col(f"_n_{c}") == 1, F.lit(False))
    checked = full.where(F.when(one, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not exactly one period of every component on "), F.col("s_plus").cast("string"))).cast("boolean")))
    return checked.drop(*[f"_n_{c}" for c in components])


def order_costs(orders: DataFrame, periods: DataFrame, *, notional: float = NOTIONAL) -> DataFrame:
    """orders (…, s_plus, weight_change, place) with side, order_value_rs, the charges, tax, total_cost_rs and slippage.

    A purchase pays stt_buy and stamp duty, a sale stt_sell and the flat depository charge, both
    the exchange's and the authority's fee and the capped brokerage, which are the tax base.
    Slippage is never taxed. An order without a place, or beyond the second band, counts to the
    second band as a fallback.
    """
    x = orders.join(charges_on(orders, periods), "s_plus")
    value, buys = F.abs("weight_change") * notional, F.col("weight_change") > 0
    x = x.withColumn("side", F.when(buys, "BUY").otherwise("SELL")).withColumn("order_value_rs", value)
    x = x.withColumn("stt_rs", value * F.when(buys, F.col("stt_buy")).otherwise(F.col("stt_sell"))).withColumn("stamp_duty_rs", F.when(buys, value * F.col("stamp_duty_buy")).otherwise(0.0))
    x = x.withColumn("tax_base_rs", value * F.col("exchange_txn") + value * F.col("sebi_fee") + F.least(value * F.col("brokerage"), F.col("brokerage_cap")))
    x = x.withColumn("indirect_tax_rs", F.col("tax_base_rs") * F.col("indirect_tax")).withColumn("dp_charge_rs", F.when(buys, 0.0).otherwise(F.col("dp_charge")))
    x = x.withColumn("total_cost_rs", F.col("stt_rs") + F.col("stamp_duty_rs") + F.col("tax_base_rs") + F.col("indirect_tax_rs") + F.col("dp_charge_rs"))
    x = x.withColumn("slippage_band", F.when(F.col("place") <= TOP_PLACE, TOP).otherwise(LOW)).withColumn("band_fallback", F.coalesce(F.col("place") > LOW_PLACE, F.lit(True)))
    for name, (first, other) in SLIPPAGE_BPS.items():
        x = x.withColumn(f"slippage_{name}_rs", value * F.when(F.col("slippage_band") == TOP, F.lit(float(first))).otherwise(float(other)) / 10_000)
    return x.drop(*COMPONENTS, "brokerage_cap")


def monthly_costs(orders: DataFrame, *, notional: float = NOTIONAL) -> DataFrame:
    """(step, t, leg, n_orders, n_sold, n_fallback, traded_fraction, traded_fraction_low, cost_fraction, cost_fraction_<scenario>)."""
    size = F.abs("weight_change")
    return orders.groupBy("step", "t", "leg").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("side") == "SELL").alias("n_sold"),
        F.count_if("band_fallback").alias("n_fallback"),
        F.sum(size).alias("traded_fraction"),
        F.sum(F.when(F.col("slippage_band") == LOW, size).otherwise(0.0)).alias("traded_fraction_low"),
        (F.sum("total_cost_rs") / notional).alias("cost_fraction"),
        *[(F.sum(F.col("total_cost_rs") + F.col(f"slippage_{s}_rs")) / notional).alias(f"cost_fraction_{s}") for s in SLIPPAGE_BPS],
    )


def net_returns(results: DataFrame, costs: DataFrame) -> DataFrame:
    """(t, gross_*, net_<leg>_<scenario>, net_WML_<scenario>, traded_fraction_<leg>, turnover_<leg>) of the months of one step that are OK.

    A month without orders costs nothing; turnover is one way.
    """
    names = ("W", "L", "BM")
    wide = costs.groupBy("t").agg(
        *[F.coalesce(F.max(F.when(F.col("leg") == p, F.col(c))), F.lit(0.0)).alias(f"_{c}_{p}") for p in names for c in ("traded_fraction", *[f"cost_fraction_{s}" for s in SLIPPAGE_BPS])]
    )
    x = results.where("status = 'OK'").select("t", *names, "WML").join(wide, "t", "left").fillna(0.0)
    cost = lambda p, s: F.col(f"_cost_fraction_{s}_{p}")
    return x.select(
        "t",
        *[F.col(p).alias(f"gross_{p}") for p in (*names, "WML")],
        *[(F.col(p) - cost(p, s)).alias(f"net_{p}_{s}") for s in SLIPPAGE_BPS for p in names],
        *[(F.col("WML") - cost("W", s) - cost("L", s)).alias(f"net_WML_{s}") for s in SLIPPAGE_BPS],
        *[F.col(f"_traded_fraction_{p}").alias(f"traded_fraction_{p}") for p in names],
        *[(F.col(f"_traded_fraction_{p}") / 2).alias(f"turnover_{p}") for p in names],
    )
