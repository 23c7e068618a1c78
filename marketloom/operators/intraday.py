"""Opening-range breakout over intraday bars, sizing, charges and the daily portfolio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """Charges of one executed order; rates are shares of turnover, slippage in basis points."""

    brokerage_flat: float = 20.0
    brokerage_pct: float = 0.0003
    stt_sell: float = 0.00025
    exchange: float = 0.00003
    sebi: float = 0.000001
    stamp_buy: float = 0.00003
    gst: float = 0.18
    slippage_bps: float = 5.0

    def __post_init__(self) -> None:
        if any(v < 0 for v in vars(self).values()):
            raise ValueError("costs must not be negative")

    def fill(self, price: Column, buys: Column) -> Column:
        s = self.slippage_bps / 10_000
        return price * F.when(buys, 1 + s).otherwise(1 - s)

    def charges(self, turnover: Column, buys: Column) -> Column:
        brokerage = F.least(F.lit(self.brokerage_flat), turnover * self.brokerage_pct)
        fees = turnover * (self.exchange + self.sebi)
        return brokerage + fees + (brokerage + fees) * self.gst + turnover * F.when(buys, self.stamp_buy).otherwise(self.stt_sell)


def tradable_sessions(bars: DataFrame, times: list[str]) -> DataFrame:
    """(symbol, session) that hold a bar at every one of the times."""
    return bars.where(F.col("time").isin(times)).groupBy("symbol", "session").agg(F.count_distinct("time").alias("n")).where(F.col("n") == len(times)).select("symbol", "session")


def breakout_signals(bars: DataFrame, *, range_times: list[str], cutoff: str) -> DataFrame:
    """(symbol, session, signal_time, side): the first close after the range beyond it; long is tested first.

    Sessions without every range bar give none. One aggregate and one filter; no bar loop.
    """
    inside = F.col("time").isin(range_times)
    last = max(range_times)
    by = Window.partitionBy("symbol", "session")
    x = bars.select("*", F.max(F.when(inside, F.col("high"))).over(by).alias("top"), F.min(F.when(inside, F.col("low"))).over(by).alias("bottom"), F.count_if(inside).over(by).alias("n"))
    out = x.where((F.col("n") == len(range_times)) & (F.col("time") > last) & (F.col("time") <= cutoff) & ((F.col("close") > F.col("top")) | (F.col("close") < F.col("bottom"))))
    first = out.groupBy("symbol", "session").agg(F.min_by(F.struct("time", "close", "top"), "time").alias("b"))
    return first.select("symbol", "session", F.col("b.time").alias("signal_time"), F.when(F.col("b.close") > F.col("b.top"), 1).otherwise(-1).alias("side"))


def breakout_trades(bars: DataFrame, signals: DataFrame, *, exit_time: str, notional: float, costs: CostModel) -> DataFrame:
    """One row per trade: filled at the open after the signal, out at the open of exit_time.

    qty is the greatest number whose fill and charges fit the notional: at most a few units below
    notional / fill, found by a filter over those candidates.
    """
    w = Window.partitionBy("symbol", "session").orderBy("time")
    y = bars.select("symbol", "session", "time", F.lead("time").over(w).alias("entry_time"), F.lead("open").over(w).alias("entry_price"), F.max(F.when(F.col("time") == exit_time, F.col("open"))).over(Window.partitionBy("symbol", "session")).alias("exit_price"))
    x = signals.join(y, (signals.symbol == y.symbol) & (signals.session == y.session) & (signals.signal_time == y.time)).select(signals.symbol, signals.session, "side", "entry_time", "entry_price", "exit_price")
    x = x.where((F.col("entry_time") < exit_time) & F.col("exit_price").isNotNull())
    buys = F.col("side") == 1
    x = x.withColumn("entry_fill", costs.fill(F.col("entry_price"), buys)).withColumn("exit_fill", costs.fill(F.col("exit_price"), ~buys))
    most = F.floor(F.lit(notional) / F.col("entry_fill"))
    fits = F.filter(F.sequence(F.greatest(most - 5, F.lit(0)), most), lambda q: q * F.col("entry_fill") + costs.charges(q * F.col("entry_fill"), buys) <= notional)
    x = x.withColumn("qty", F.array_max(fits)).where("qty > 0")
    gross = F.col("qty") * F.col("side") * (F.col("exit_price") - F.col("entry_price"))
    slipped = F.col("qty") * (F.abs(F.col("entry_fill") - F.col("entry_price")) + F.abs(F.col("exit_fill") - F.col("exit_price")))
    charges = costs.charges(F.col("qty") * F.col("entry_fill"), buys) + costs.charges(F.col("qty") * F.col("exit_fill"), ~buys)
    x = x.withColumn("gross_pnl", gross).withColumn("slippage", slipped).withColumn("total_charges", charges)
    return x.withColumn("net_pnl", F.col("gross_pnl") - F.col("slippage") - F.col("total_charges"))


def portfolio_by_day(trades: DataFrame, sessions: DataFrame, *, n_symbols: int, notional: float) -> DataFrame:
    """(session, gross_pnl, slippage, total_charges, net_pnl, n_trades, net_ret); days without trades stay as zeros."""
    per = trades.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("gross_pnl", "slippage", "total_charges", "net_pnl")], F.count(F.lit(1)).alias("n_trades"))
    x = sessions.select("session").distinct().join(per, "session", "left").fillna(0)
    return x.withColumn("net_ret", F.col("net_pnl") / (n_symbols * notional))
