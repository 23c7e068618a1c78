"""Next-open backtests of 0/1 positions, and their report.

Without stops the equity is a running product of per-bar growth factors, all windows over one
exchange. With stops a fold runs once over each symbol's bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.indicators import UNTIL_NOW, by_symbol

COST = 0.001


def equity_curve(bars: DataFrame, *, cash: float = 100_000.0, cost: float = COST) -> DataFrame:
    """bars (symbol, ts, open, close, position) with held and equity.

    The position decided at a close is filled at the next open, all money in or out, with the cost
    on each side. The first bar holds nothing.
    """
    w = by_symbol()
    x = bars.withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    x = x.withColumn("was", F.coalesce(F.lag("held").over(w), F.lit(0))).withColumn("prev", F.lag("close").over(w))
    enter = (F.col("held") == 1) & (F.col("was") == 0)
    leave = (F.col("held") == 0) & (F.col("was") == 1)
    growth = F.when(enter, (1 - cost) * F.col("close") / F.col("open")).when(leave, (1 - cost) * F.col("open") / F.col("prev")).when(F.col("held") == 1, F.col("close") / F.col("prev")).otherwise(1.0)
    return x.withColumn("equity", F.product(growth).over(w.rowsBetween(*UNTIL_NOW)) * cash).drop("was", "prev")


def round_trips(curve: DataFrame) -> DataFrame:
    """(symbol, entry_ts, entry, exit_ts, exit, pnl_pct): one row per trade; an open one has no exit."""
    w = by_symbol()
    x = curve.withColumn("turn", F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0))).where("turn != 0")
    x = x.withColumn("exit_ts", F.lead("ts").over(w)).withColumn("exit", F.lead("open").over(w)).where("turn = 1")
    return x.select("symbol", F.col("ts").alias("entry_ts"), F.col("open").alias("entry"), "exit_ts", "exit", ((F.col("exit") / F.col("open") - 1) * 100).alias("pnl_pct"))


def sharpe(returns: Column, n_year: int = 252) -> Column:
    """Mean over sample deviation, annualised; 0 if flat or fewer than two."""
    sd = F.stddev_samp(returns)
    return F.when((F.count(returns) >= 2) & (sd > 0), F.avg(returns) / sd * (n_year**0.5)).otherwise(0.0)


def report(curve: DataFrame) -> DataFrame:
    """Per symbol: strategy and buy-and-hold return, drawdown, growth a year, Sharpe, exposure, trades, win rate."""
    w = by_symbol()
    x = curve.withColumn("peak", F.max("equity").over(w.rowsBetween(*UNTIL_NOW))).withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    years = F.datediff(F.max("ts"), F.min("ts")) / 365.25
    total = F.max_by("equity", "ts") / 100_000.0
    per = x.groupBy("symbol").agg(
        ((total - 1) * 100).alias("return_pct"),
        ((F.max_by("close", "ts") / F.min_by("open", "ts") - 1) * 100).alias("buy_hold_pct"),
        (F.min((F.col("equity") - F.col("peak")) / F.col("peak")) * 100).alias("max_drawdown_pct"),
        F.when((years > 0) & (total > 0), (F.pow(total, F.try_divide(F.lit(1.0), years)) - 1) * 100).otherwise(0.0).alias("cagr_pct"),
        sharpe(F.col("r")).alias("sharpe"),
        (F.avg("held") * 100).alias("exposure_pct"),
    )
    trades = round_trips(curve).groupBy("symbol").agg(F.count("exit").alias("trades"), F.try_divide(F.count_if(F.col("pnl_pct") > 0) * 100.0, F.count("exit")).alias("win_rate_pct"))
    return per.join(trades, "symbol", "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def stopped_trades(bars: DataFrame, *, stop_loss: float | None = None, trailing_stop: float | None = None) -> DataFrame:
    """(symbol, entry_ts, entry, exit_ts, exit, pnl_pct, reason) with stops checked at every close.

    A close below the stop is sold at the next open as "stop"; then no entry until a later bar has
    seen the signal off. A trade still held at the end is "open" without exit. A JVM fold over
    each symbol's sorted bars, as many as its sessions; its state is one struct.
    """
    trade = "entry_ts date, entry double, exit_ts date, exit double, pnl_pct double, reason string"
    start = F.lit(None).cast(f"struct<wanted:int, inside:boolean, entry_ts:date, entry:double, peak:double, stopped:boolean, barred:boolean, trades:array<struct<{trade.replace(' ', ':').replace(',:', ',')}>>>")
    no, nothing = F.lit(False), F.lit(None)

    def step(s: Column, bar: Column) -> Column:
        was_in, due = F.coalesce(s["inside"], no), F.coalesce(s["stopped"], no)
        signal = F.coalesce(s["wanted"], F.lit(0)) == 1  # of the bar before
        barred = F.coalesce(s["barred"], no) & signal
        sells, buys = was_in & (due | ~signal), ~was_in & signal & ~barred
        inside = (was_in & ~sells) | buys
        entry = F.when(buys, bar["open"]).otherwise(s["entry"])
        top = F.when(buys, F.greatest(bar["open"], bar["close"])).otherwise(F.greatest(s["peak"], bar["close"]))
        floors = [entry * (1 - stop_loss)] if stop_loss is not None else []
        floors += [top * (1 - trailing_stop)] if trailing_stop is not None else []
        below = F.coalesce(bar["close"] < (F.greatest(*floors) if len(floors) > 1 else floors[0]), no) if floors else no
        done = F.struct(s["entry_ts"].alias("entry_ts"), s["entry"].alias("entry"), bar["ts"].alias("exit_ts"), bar["open"].alias("exit"), ((bar["open"] / s["entry"] - 1) * 100).alias("pnl_pct"), F.when(due, "stop").otherwise("signal").alias("reason"))
        trades = F.coalesce(s["trades"], F.array().cast(f"array<struct<{trade.replace(' ', ':').replace(',:', ',')}>>"))
        return F.struct(
            bar["position"].cast("int").alias("wanted"),
            inside.alias("inside"),
            F.when(buys, bar["ts"]).otherwise(s["entry_ts"]).alias("entry_ts"),
            entry.alias("entry"),
            top.alias("peak"),
            (inside & below).alias("stopped"),
            (barred | (sells & due)).alias("barred"),
            F.when(sells, F.concat(trades, F.array(done))).otherwise(trades).alias("trades"),
        )

    def finish(s: Column) -> Column:
        still = F.struct(s["entry_ts"].alias("entry_ts"), s["entry"].alias("entry"), nothing.cast("date").alias("exit_ts"), nothing.cast("double").alias("exit"), nothing.cast("double").alias("pnl_pct"), F.lit("open").alias("reason"))
        return F.when(s["inside"], F.concat(s["trades"], F.array(still))).otherwise(s["trades"])

    packed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "open", "close", "position"))).alias("rows"))
    return packed.select("symbol", F.inline(F.aggregate("rows", start, step, finish)))


def rotation(bars: DataFrame, *, look_back: int = 126, every: int = 21, top: int = 2, cost: float = COST) -> DataFrame:
    """(i, ts, picks, growth): at every rebalance the best symbols by past return, held equally to the next.

    bars: symbol, ts, close on common days. The cost of two sides is paid only when the set changes.
    """
    w, day = by_symbol(), Window.partitionBy("ts")
    x = bars.withColumn("i", F.row_number().over(w) - 1).withColumn("past", F.col("close") / F.lag("close", look_back).over(w) - 1).withColumn("next", F.lead("close", every).over(w) / F.col("close"))
    x = x.where((F.col("i") >= look_back) & ((F.col("i") - look_back) % every == 0))
    best = x.withColumn("place", F.row_number().over(day.orderBy(F.col("past").desc(), "symbol"))).where(F.col("place") <= top)
    turns = best.groupBy("i", "ts").agg(F.array_join(F.sort_array(F.collect_list("symbol")), "|").alias("picks"), F.avg("next").alias("growth"))
    # one row per rebalance of the calendar
    order = Window.partitionBy(F.lit(0)).orderBy("i")
    paid = F.when(F.coalesce(F.lag("picks").over(order) != F.col("picks"), F.lit(True)), 1 - 2 * cost).otherwise(1.0)
    return turns.withColumn("growth", F.col("growth") * paid)
