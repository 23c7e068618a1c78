"""Backtests, rotation and intraday breakout over derived bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import backtest as B
from marketloom.operators import indicators as I
from marketloom.operators import intraday as D
from marketloom.plans.bars import BARS, HOURS, daily_bars, hourly_bars, r6

RANGE, CUTOFF, EXIT, NOTIONAL = ["09:00", "10:00"], "14:00", "15:00", 100_000.0
REQUIRED = [f"{h:02d}:00" for h in range(9, 16)]
COSTS = D.CostModel()


def _positions(spark, d):
    return I.crossover(I.sma(I.sma(daily_bars(spark, d), 5), 20), "sma_5", "sma_20")


def bt_equity(spark, d):
    """O-S1 without stops: equity of the 5/20 crossover."""
    return B.equity_curve(_positions(spark, d)).select("symbol", "ts", "held", r6(F.log("equity")).alias("log_equity"))


def bt_trades(spark, d):
    """O-S1: round trips of the crossover."""
    return B.round_trips(B.equity_curve(_positions(spark, d))).select("symbol", "entry_ts", "entry", "exit_ts", "exit", r6(F.col("pnl_pct")).alias("pnl_pct"))


def bt_report(spark, d):
    """O-G16, O-F10, O-T1: report of the crossover by symbol."""
    x = B.report(B.equity_curve(_positions(spark, d)))
    cols = ["return_pct", "buy_hold_pct", "max_drawdown_pct", "cagr_pct", "sharpe", "exposure_pct", "win_rate_pct"]
    return x.select("symbol", "trades", *[r6(F.col(c)).alias(c) for c in cols])


def bt_stops(spark, d):
    """O-S1 with a stop of 50 % and a trailing stop of 80 %."""
    return B.stopped_trades(_positions(spark, d), stop_loss=0.5, trailing_stop=0.8)


def bt_rotation(spark, d):
    """O-S10: rotation into the best two symbols on the days that all share."""
    x = daily_bars(spark, d).select("symbol", "ts", "close")
    shared = x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where("n = 5").drop("n")
    return B.rotation(shared).select("i", "ts", "picks", r6(F.col("growth")).alias("growth"))


def bt_forest(spark, d):
    """O-S11: hit rate of a random forest on unseen rows, by symbol."""
    from marketloom.operators.model import forest_positions

    return forest_positions(daily_bars(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("target") == F.col("position")).cast("int"))).alias("hit_rate"))


def paper_trades(spark, d):
    """O-S9: the stateful trader replayed over daily bars."""
    from marketloom.streaming.bars import trade_batch

    return trade_batch(daily_bars(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))


def orb_tradable(spark, d):
    """O-S2, O-F7: sessions with every required bar."""
    return D.tradable_sessions(hourly_bars(spark, d), REQUIRED)


def _signals(spark, d):
    bars = hourly_bars(spark, d)
    good = D.tradable_sessions(bars, REQUIRED)
    bars = bars.join(good, ["symbol", "session"], "left_semi")
    return bars, D.breakout_signals(bars, range_times=RANGE, cutoff=CUTOFF)


def orb_signals(spark, d):
    """O-S3: first breakout of each tradable session."""
    return _signals(spark, d)[1].select("symbol", "session", "signal_time", "side")


def _trades(spark, d):
    bars, signals = _signals(spark, d)
    return D.breakout_trades(bars, signals, exit_time=EXIT, notional=NOTIONAL, costs=COSTS)


def orb_trades(spark, d):
    """O-S4, O-S5, O-S7, O-F11, O-F12: sized trades with charges."""
    return _trades(spark, d).select("symbol", "session", "side", "entry_time", F.col("qty").cast("bigint").alias("qty"), r6(F.col("gross_pnl")).alias("gross_pnl"), r6(F.col("total_charges")).alias("total_charges"), r6(F.col("net_pnl")).alias("net_pnl"))


def orb_portfolio(spark, d):
    """O-G13: the portfolio's day, zero days kept."""
    x = D.portfolio_by_day(_trades(spark, d), hourly_bars(spark, d), n_symbols=5, notional=NOTIONAL)
    return x.select("session", "n_trades", r6(F.col("net_pnl")).alias("net_pnl"), r6(F.col("net_ret")).alias("net_ret"))


def orb_summary(spark, d):
    """O-G14: profit factor, win rate and worst trade by symbol."""
    t = _trades(spark, d)
    won, lost = F.sum(F.when(F.col("net_pnl") > 0, F.col("net_pnl"))), -F.sum(F.when(F.col("net_pnl") <= 0, F.col("net_pnl")))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), r6(F.avg((F.col("net_pnl") > 0).cast("int")) * 100).alias("win_rate_pct"), r6(F.try_divide(won, lost)).alias("profit_factor"), r6(F.min("net_pnl")).alias("worst"))


def orb_benchmark(spark, d):
    """O-S6: buying the first bar of a tradable session, selling at the exit bar."""
    bars = hourly_bars(spark, d).join(D.tradable_sessions(hourly_bars(spark, d), REQUIRED), ["symbol", "session"], "left_semi")
    x = bars.groupBy("symbol", "session").agg(F.max(F.when(F.col("time") == "09:00", F.col("open"))).alias("bought"), F.max(F.when(F.col("time") == EXIT, F.col("open"))).alias("sold"))
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.try_divide("sold", "bought") - 1)).alias("mean_ret"))


def orb_entry_times(spark, d):
    """O-P17: trades by entry time and side."""
    return _trades(spark, d).groupBy("entry_time", "side").agg(F.count(F.lit(1)).alias("n"))


def orb_scenarios(spark, d):
    """Net result of the same signals under several slippages."""
    bars, signals = _signals(spark, d)
    out = None
    for bps in (0.0, 5.0, 10.0):
        t = D.breakout_trades(bars, signals, exit_time=EXIT, notional=NOTIONAL, costs=D.CostModel(slippage_bps=bps)).agg(F.count(F.lit(1)).alias("trades"), r6(F.sum("net_pnl")).alias("net_pnl")).withColumn("bps", F.lit(bps))
        out = t if out is None else out.unionByName(t)
    return out


_NAMES = "bt_equity bt_trades bt_report bt_stops bt_rotation bt_forest paper_trades orb_tradable orb_signals orb_trades orb_portfolio orb_summary orb_benchmark orb_entry_times orb_scenarios"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = "(partition by symbol order by ts"
_POS = f"""{BARS}, av as (select *, case when count(close) over {_W} rows between 4 preceding and current row) = 5 then avg(close) over {_W} rows between 4 preceding and current row) end as f,
  case when count(close) over {_W} rows between 19 preceding and current row) = 20 then avg(close) over {_W} rows between 19 preceding and current row) end as s from bars),
h as (select *, coalesce(lag(coalesce(f > s, false)::int) over {_W}), 0) as held, lag(close) over {_W}) as prev from av),
g as (select *, coalesce(lag(held) over {_W}), 0) as was from h),
eq as (select *, product(case when held = 1 and was = 0 then 0.999::double * close / open when held = 0 and was = 1 then 0.999::double * open / prev when held = 1 then close / prev else 1.0::double end) over {_W} rows unbounded preceding) * 100000 as equity from g),
tr as (select symbol, ts as entry_ts, open as entry, lead(ts) over {_W}) as exit_ts, lead(open) over {_W}) as exit, held - was as turn from eq where held <> was),
trades as (select symbol, entry_ts, entry, exit_ts, exit, (exit / entry - 1) * 100 as pnl_pct from tr where turn = 1)"""


def _orb(bps: float) -> str:
    c = COSTS
    up, down, inside = 1 + bps / 10_000, 1 - bps / 10_000, "time in ('09:00', '10:00')"

    def charge(t, buy):
        b = f"least({c.brokerage_flat}::double, {t} * {c.brokerage_pct}::double)"
        fees = f"{t} * {c.exchange + c.sebi!r}::double"
        return f"({b} + {fees} + ({b} + {fees}) * {c.gst}::double + {t} * case when {buy} then {c.stamp_buy!r}::double else {c.stt_sell!r}::double end)"

    fit = f"(q * ef + {charge('q * ef', 'side = 1')} <= {NOTIONAL})"
    return f"""{HOURS}, ok as (select symbol, session from hours where time between '09:00' and '15:00' group by 1, 2 having count(*) = 7), b as (select hours.* from hours join ok using (symbol, session)),
r as (select *, max(high) filter ({inside}) over (partition by symbol, session) as top, min(low) filter ({inside}) over (partition by symbol, session) as bottom, lead(time) over (partition by symbol, session order by time) as entry_time, lead(open) over (partition by symbol, session order by time) as ep, max(open) filter (time = '15:00') over (partition by symbol, session) as xp from b),
sig as (select *, case when close > top then 1 else -1 end as side from r where time > '10:00' and time <= '14:00' and (close > top or close < bottom) qualify row_number() over (partition by symbol, session order by time) = 1),
f as (select *, ep * case when side = 1 then {up!r}::double else {down!r}::double end as ef, xp * case when side = 1 then {down!r}::double else {up!r}::double end as xf from sig where entry_time < '15:00'),
q as (select *, floor({NOTIONAL} / ef) as most from f),
z as (select q.*, (select max(q) from (select most - k as q from (values (0), (1), (2), (3), (4), (5)) v(k)) where q >= 0 and {fit}) as qty from q),
t as (select *, qty * side * (xp - ep) as gross_pnl, qty * (abs(ef - ep) + abs(xf - xp)) as slippage, {charge('qty * ef', 'side = 1')} + {charge('qty * xf', 'side = -1')} as total_charges from z where qty > 0),
trades as (select *, gross_pnl - slippage - total_charges as net_pnl from t)"""


_ORB = _orb(COSTS.slippage_bps)
_R = "round({0}, 6) + 0.0 as {0}"
SQL = {
    "bt_equity": f"with {_POS} select symbol, ts, held, round(ln(equity), 6) + 0.0 as log_equity from eq",
    "bt_trades": f"with {_POS} select symbol, entry_ts, entry, exit_ts, exit, {_R.format('pnl_pct')} from trades",
    "bt_report": f"""with {_POS}, p as (select *, max(equity) over {_W} rows unbounded preceding) as peak, equity / lag(equity) over {_W}) - 1 as r from eq),
a as (select symbol, arg_max(equity, ts) / 100000 as total, arg_max(close, ts) / arg_min(open, ts) as bh, min((equity - peak) / peak) * 100 as dd, (max(ts) - min(ts)) / 365.25::double as years, count(r) as n, avg(r) as m, stddev_samp(r) as sd, avg(held) * 100 as ex from p group by 1),
k as (select symbol, count(exit) as trades, count(*) filter (pnl_pct > 0) * 100.0 / count(exit) as wr from trades group by 1)
select symbol, coalesce(trades, 0) as trades, round((total - 1) * 100, 6) + 0.0 as return_pct, round((bh - 1) * 100, 6) + 0.0 as buy_hold_pct, round(dd, 6) + 0.0 as max_drawdown_pct, round(case when years > 0 and total > 0 then (power(total, 1 / years) - 1) * 100 else 0 end, 6) + 0.0 as cagr_pct, round(case when n >= 2 and sd > 0 then m / sd * sqrt(252) else 0 end, 6) + 0.0 as sharpe, round(ex, 6) + 0.0 as exposure_pct, round(wr::double, 6) + 0.0 as win_rate_pct from a left join k using (symbol)""",
    "bt_rotation": f"""with {BARS}, s as (select symbol, ts, close from bars qualify count(*) over (partition by ts) = 5),
x as (select symbol, ts, row_number() over {_W}) - 1 as i, close / lag(close, 126) over {_W}) - 1 as past, lead(close, 21) over {_W}) / close as nxt from s),
b as (select * from x where i >= 126 and (i - 126) % 21 = 0 qualify row_number() over (partition by ts order by past desc, symbol) <= 2),
t as (select i, ts, string_agg(symbol, '|' order by symbol) as picks, avg(nxt) as growth from b group by 1, 2)
select i::int as i, ts, picks, round(growth * case when coalesce(lag(picks) over (order by i) <> picks, true) then 0.998::double else 1 end, 6) + 0.0 as growth from t""",
    "orb_tradable": f"with {HOURS} select symbol, session from hours where time between '09:00' and '15:00' group by 1, 2 having count(*) = 7",
    "orb_signals": f"with {_ORB} select symbol, session, time as signal_time, side from sig",
    "orb_trades": f"with {_ORB} select symbol, session, side, entry_time, qty::bigint as qty, {_R.format('gross_pnl')}, {_R.format('total_charges')}, {_R.format('net_pnl')} from trades",
    "orb_portfolio": f"with {_ORB}, p as (select session, count(*) as n, sum(net_pnl) as net from trades group by 1) select session, coalesce(n, 0) as n_trades, round(coalesce(net, 0), 6) + 0.0 as net_pnl, round(coalesce(net, 0) / 500000, 6) + 0.0 as net_ret from (select distinct session from hours) left join p using (session)",
    "orb_summary": f"with {_ORB} select symbol, count(*) as trades, round(avg((net_pnl > 0)::int) * 100, 6) + 0.0 as win_rate_pct, round(sum(net_pnl) filter (net_pnl > 0) / -sum(net_pnl) filter (net_pnl <= 0), 6) + 0.0 as profit_factor, round(min(net_pnl), 6) + 0.0 as worst from trades group by 1",
    "orb_benchmark": f"with {HOURS}, ok as (select symbol, session from hours where time between '09:00' and '15:00' group by 1, 2 having count(*) = 7), x as (select symbol, session, max(open) filter (time = '09:00') as a, max(open) filter (time = '15:00') as b from hours join ok using (symbol, session) group by 1, 2) select symbol, count(*) as n, round(avg(b / nullif(a, 0) - 1), 6) + 0.0 as mean_ret from x group by 1",
    "orb_entry_times": f"with {_ORB} select entry_time, side, count(*) as n from trades group by 1, 2",
    "orb_scenarios": " union all ".join(f"select * from (with {_orb(b)} select count(*) as trades, round(sum(net_pnl), 6) + 0.0 as net_pnl, {b}::double as bps from trades)" for b in (0.0, 5.0, 10.0)),
}
