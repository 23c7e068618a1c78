"""Ordered-series functions over derived bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as I
from marketloom.plans.bars import BARS, MONTHS, daily_bars, month_panel, r6

W = I.by_symbol


def NOW():
    return W().rowsBetween(*I.UNTIL_NOW)


def win_sma(spark, d):
    """O-W1: simple averages of 5 and 20 closes."""
    x = I.sma(I.sma(daily_bars(spark, d), 5), 20)
    return x.select("symbol", "ts", r6(F.col("sma_5")).alias("sma_5"), r6(F.col("sma_20")).alias("sma_20"))


def win_ema(spark, d):
    """O-W2: exponential average over 12 closes."""
    return I.ema(daily_bars(spark, d), 12).select("symbol", "ts", r6(F.col("ema_12")).alias("ema_12"))


def win_crossover(spark, d):
    """O-W3: position of the 5/20 crossover."""
    x = I.crossover(I.sma(I.sma(daily_bars(spark, d), 5), 20), "sma_5", "sma_20")
    return x.select("symbol", "ts", "position")


def win_pct_change(spark, d):
    """O-W4, O-W5: changes over 1 and 5 rows, next row's change, deviation of 20 changes."""
    x = daily_bars(spark, d).withColumn("c1", I.change("close", 1))
    return x.select("symbol", "ts", r6(F.col("c1")).alias("chg_1"), r6(I.change("close", 5)).alias("chg_5"), r6(F.lead("c1").over(W())).alias("next_chg"), r6(I.full_window(F.stddev_samp, F.col("c1"), 20, W())).alias("vol_20"))


def win_drawdown(spark, d):
    """O-W6: running peak and drawdown in per cent."""
    x = daily_bars(spark, d)
    return x.select("symbol", "ts", F.max("close").over(NOW()).alias("peak"), r6(I.drawdown("close") * 100).alias("drawdown_pct"))


def win_wealth(spark, d):
    """O-W7: logarithm of the running product of growth."""
    x = daily_bars(spark, d).withColumn("g", F.coalesce(I.change("close", 1), F.lit(0.0)) / 100 + 1)
    return x.select("symbol", "ts", r6(F.log(F.product("g").over(NOW()))).alias("log_wealth"))


def win_formation(spark, d):
    """O-W8: compounded return over the twelve months before last, by prefix sums of logs."""
    w = Window.partitionBy("entity").orderBy("month")
    x = month_panel(spark, d).withColumn("i", F.row_number().over(w)).withColumn("s", F.sum(F.log1p(F.col("value") / 1e9)).over(w.rowsBetween(*I.UNTIL_NOW)))
    return x.select("entity", "month", r6(F.expm1(F.lag("s", 1).over(w) - F.lag("s", 12).over(w))).alias("formation"))


def win_expanding_median(spark, d):
    """O-W9: median of all values up to each month."""
    x = I.expanding_median(month_panel(spark, d), "value", "median", "entity", "month")
    return x.select("entity", "month", r6(F.col("median")).alias("median_so_far"))


def win_cumcount(spark, d):
    """O-W10: rank within the month by value, ties by entity."""
    w = Window.partitionBy("month").orderBy(F.col("value").desc(), "entity")
    return month_panel(spark, d).select("entity", "month", F.row_number().over(w).cast("long").alias("place"))


def win_islands(spark, d):
    """O-W11, O-W12: segments of days with gaps of at most one session of the market."""
    x = daily_bars(spark, d)
    days = x.select("ts").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")))
    x = x.join(days, "ts").withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(W()), F.lit(99)) > 1).cast("int"))
    x = x.withColumn("part", F.sum("new").over(NOW()))
    return x.groupBy("symbol", "part").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n_sessions"))


def win_out_of_order(spark, d):
    """O-W13, O-W14: orders dated before an earlier key's date of the customer; duplicates of a day."""
    from marketloom.session import table

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    o = o.select("*", F.max("day").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "day")).alias("n"))
    return o.select("o_orderkey", F.coalesce(F.col("day") < F.col("top"), F.lit(False)).cast("int").alias("backwards"), (F.col("n") > 1).cast("int").alias("duplicated"))


def win_ffill(spark, d):
    """O-W15, O-J20: calendar of the market by symbol, closes carried forward."""
    x = daily_bars(spark, d).select("symbol", "ts", "close")
    days = x.select(F.collect_set("ts")).scalar()  # no more than calendar days
    spine = x.select("symbol").distinct().select("symbol", F.explode(days).alias("ts"))
    full = spine.join(x, ["symbol", "ts"], "left")
    return full.select("symbol", "ts", F.last("close", ignorenulls=True).over(NOW()).alias("close"))


def win_runs(spark, d):
    """O-W16: runs of equal direction."""
    x = daily_bars(spark, d).withColumn("up", (F.col("close") >= F.col("open")).cast("int"))
    x = x.withColumn("part", F.sum((F.coalesce(F.lag("up").over(W()) != F.col("up"), F.lit(True))).cast("int")).over(NOW()))
    return x.groupBy("symbol", "part", "up").agg(F.count(F.lit(1)).alias("length"), F.min("ts").alias("start"))


def win_cumulative_gap(spark, d):
    """O-W17: running sum of close minus open."""
    return daily_bars(spark, d).select("symbol", "ts", F.sum((F.col("close") - F.col("open")).cast("decimal(18,2)")).over(NOW()).cast("double").alias("running"))


def win_autocovariance(spark, d):
    """O-W18: autocovariances of daily changes at lags 0 to 5, divided by n."""
    x = daily_bars(spark, d).withColumn("c", I.change("close", 1)).where("c is not null")
    x = x.withColumn("m", F.col("c") - F.avg("c").over(Window.partitionBy("symbol")))
    for k in range(6):
        x = x.withColumn(f"l{k}", F.col("m") * (F.lag("m", k).over(W()) if k else F.col("m")))
    out = x.groupBy("symbol").agg(*[(F.sum(f"l{k}") / F.count(F.lit(1))).alias(f"l{k}") for k in range(6)])
    return out.select("symbol", *[r6(F.col(f"l{k}")).alias(f"acov_{k}") for k in range(6)])


def ui_return_vol(spark, d):
    """O-U1, O-U2: per cent return over 20 rows; annualised deviation of 20 log returns."""
    x = daily_bars(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(W())))
    return x.select("symbol", "ts", r6(I.change("close", 20) * 100).alias("ret_20"), r6(I.full_window(F.stddev_samp, F.col("lr"), 20, W()) * (252**0.5) * 100).alias("vol"))


def ui_rsi(spark, d):
    """O-U3: Wilder's relative strength index of the last 250 closes."""
    x = daily_bars(spark, d)
    last = x.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))).where("n <= 250").drop("n")
    return I.wilder_rsi(last).select("symbol", r6(F.col("rsi")).alias("rsi"))


def ui_regime(spark, d):
    """O-U4, O-U5: trend label against the 50 average; calm or wild against the upper median deviation."""
    x = daily_bars(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(W())))
    x = x.withColumn("vol", I.full_window(F.stddev_samp, F.col("lr"), 20, W())).withColumn("avg", I.full_window(F.avg, F.col("close"), 50, W()))
    known = x.where("vol is not null")
    ranked = known.select("symbol", "vol", F.row_number().over(Window.partitionBy("symbol").orderBy("vol", "ts")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    mid = ranked.where("i = floor(n / 2) + 1").select("symbol", F.col("vol").alias("mid"))
    y = known.where("avg is not null").join(mid, "symbol")
    return y.select("symbol", "ts", F.when(F.col("close") > F.col("avg"), "UP").otherwise("DOWN").alias("trend"), F.when(F.col("vol") > F.col("mid"), "HIGH").otherwise("LOW").alias("volatility"))


def ui_range52(spark, d):
    """O-U6: highest and lowest close of 252 rows and average volume of 20, on each symbol's last day."""
    x = daily_bars(spark, d)
    x = x.select("symbol", "ts", F.max("high").over(W().rowsBetween(-251, 0)).alias("high_52"), F.min("low").over(W().rowsBetween(-251, 0)).alias("low_52"), r6(F.avg("volume").over(W().rowsBetween(-19, 0))).alias("volume_20"), F.max("ts").over(Window.partitionBy("symbol")).alias("t"))
    return x.where("ts = t").drop("t")


QUERIES = {f.__name__: f for f in (win_sma, win_ema, win_crossover, win_pct_change, win_drawdown, win_wealth, win_formation, win_expanding_median, win_cumcount, win_islands, win_out_of_order, win_ffill, win_runs, win_cumulative_gap, win_autocovariance, ui_return_vol, ui_rsi, ui_regime, ui_range52)}

_W = "(partition by symbol order by ts"
_AVG = "case when count(close) over {w} = {n} then avg(close) over {w} end"
_SMA = {n: _AVG.format(w=f"{_W} rows between {n - 1} preceding and current row)", n=n) for n in (5, 20, 50)}
_SD = f"case when count({{c}}) over {_W} rows between 19 preceding and current row) = 20 then stddev_samp({{c}}) over {_W} rows between 19 preceding and current row) end"
SQL = {
    "win_sma": f"with {BARS} select symbol, ts, round({_SMA[5]}, 6) + 0.0 as sma_5, round({_SMA[20]}, 6) + 0.0 as sma_20 from bars",
    "win_ema": f"with recursive {BARS}, s as (select *, row_number() over {_W}) as i from bars), e as (select symbol, ts, i, close as y from s where i = 1 union all select s.symbol, s.ts, s.i, s.close * (2.0::double / 13) + e.y * (1 - 2.0::double / 13) from e join s on s.symbol = e.symbol and s.i = e.i + 1) select symbol, ts, round(y, 6) + 0.0 as ema_12 from e",
    "win_crossover": f"with {BARS}, a as (select symbol, ts, {_SMA[5]} as f, {_SMA[20]} as s from bars) select symbol, ts, coalesce(f > s, false)::int as position from a",
    "win_pct_change": f"with {BARS}, a as (select symbol, ts, close, close / lag(close) over {_W}) - 1 as c1 from bars) select symbol, ts, round(c1, 6) + 0.0 as chg_1, round(close / lag(close, 5) over {_W}) - 1, 6) + 0.0 as chg_5, round(lead(c1) over {_W}), 6) + 0.0 as next_chg, round({_SD.format(c='c1')}, 6) + 0.0 as vol_20 from a",
    "win_drawdown": f"with {BARS}, a as (select symbol, ts, close, max(close) over {_W} rows unbounded preceding) as peak from bars) select symbol, ts, peak, round((close - peak) / peak * 100, 6) + 0.0 as drawdown_pct from a",
    "win_wealth": f"with {BARS}, a as (select symbol, ts, coalesce(close / lag(close) over {_W}) - 1, 0) / 100 + 1 as g from bars) select symbol, ts, round(ln(product(g) over {_W} rows unbounded preceding)), 6) + 0.0 as log_wealth from a",
    "win_formation": f"with {MONTHS}, a as (select *, sum(ln(1 + value / 1e9)) over (partition by entity order by month rows unbounded preceding) as s from months) select entity, month, round(exp(lag(s, 1) over w - lag(s, 12) over w) - 1, 6) + 0.0 as formation from a window w as (partition by entity order by month)",
    "win_expanding_median": f"with {MONTHS} select entity, month, round(quantile_cont(value, 0.5) over (partition by entity order by month rows unbounded preceding), 6) + 0.0 as median_so_far from months",
    "win_cumcount": f"with {MONTHS} select entity, month, row_number() over (partition by month order by value desc, entity) as place from months",
    "win_islands": f"with {BARS}, p as (select ts, row_number() over (order by ts) as pos from (select distinct ts from bars)), a as (select symbol, ts, (coalesce(pos - lag(pos) over {_W}), 99) > 1)::int as new from bars join p using (ts)), b as (select *, sum(new) over {_W} rows unbounded preceding) as part from a) select symbol, part::bigint as part, min(ts) as first, max(ts) as last, count(*) as n_sessions from b group by symbol, part",
    "win_out_of_order": "with o as (select o_custkey, o_orderkey, o_orderdate::date as day from orders) select o_orderkey, coalesce(day < max(day) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), false)::int as backwards, (count(*) over (partition by o_custkey, day) > 1)::int as duplicated from o",
    "win_ffill": f"with {BARS}, s as (select symbol, ts from (select distinct symbol from bars) cross join (select distinct ts from bars)) select s.symbol, s.ts, last_value(b.close ignore nulls) over (partition by s.symbol order by s.ts rows unbounded preceding) as close from s left join bars b on b.symbol = s.symbol and b.ts = s.ts",
    "win_runs": f"with {BARS}, a as (select symbol, ts, (close >= open)::int as up from bars), b as (select *, coalesce(lag(up) over {_W}) <> up, true)::int as new from a), c as (select *, sum(new) over {_W} rows unbounded preceding) as part from b) select symbol, part::bigint as part, up, count(*) as length, min(ts) as start from c group by symbol, part, up",
    "win_cumulative_gap": f"with {BARS} select symbol, ts, (sum((close - open)::decimal(18,2)) over {_W} rows unbounded preceding))::double as running from bars",
    "win_autocovariance": f"with {BARS}, a as (select symbol, ts, close / lag(close) over {_W}) - 1 as c from bars), b as (select symbol, ts, c - avg(c) over (partition by symbol) as m from a where c is not null), k as (select symbol, m * m as l0, " + ", ".join(f"m * lag(m, {k}) over {_W}) as l{k}" for k in range(1, 6)) + " from b) select symbol, " + ", ".join(f"round(sum(l{k}) / count(*), 6) + 0.0 as acov_{k}" for k in range(6)) + " from k group by symbol",
    "ui_return_vol": f"with {BARS}, a as (select *, ln(close / lag(close) over {_W})) as lr from bars) select symbol, ts, round((close / lag(close, 20) over {_W}) - 1) * 100, 6) + 0.0 as ret_20, round({_SD.format(c='lr')} * sqrt(252) * 100, 6) + 0.0 as vol from a",
    "ui_rsi": f"with recursive {BARS}, l as (select * from bars qualify row_number() over (partition by symbol order by ts desc) <= 250), m as (select symbol, close - lag(close) over {_W}) as mv, row_number() over {_W}) - 1 as i from l), g as (select symbol, 14 as i, sum(greatest(mv, 0)) / 14 as g, sum(greatest(-mv, 0)) / 14 as l from m where i between 1 and 14 group by symbol having count(*) = 14 union all select g.symbol, m.i, (g.g * 13 + greatest(m.mv, 0)) / 14, (g.l * 13 + greatest(-m.mv, 0)) / 14 from g join m on m.symbol = g.symbol and m.i = g.i + 1) select symbol, round(case when l = 0 then 100 else 100 - 100 / (1 + g / l) end, 6) + 0.0 as rsi from g qualify i = max(i) over (partition by symbol)",
    "ui_regime": f"with {BARS}, a as (select *, ln(close / lag(close) over {_W})) as lr from bars), b as (select symbol, ts, close, {_SD.format(c='lr')} as vol, {_SMA[50]} as av from a), k as (select symbol, vol, row_number() over (partition by symbol order by vol, ts) as i, count(*) over (partition by symbol) as n from b where vol is not null), md as (select symbol, vol as mid from k where i = n // 2 + 1) select symbol, ts, case when close > av then 'UP' else 'DOWN' end as trend, case when vol > mid then 'HIGH' else 'LOW' end as volatility from b join md using (symbol) where vol is not null and av is not null",
    "ui_range52": f"with {BARS} select symbol, ts, max(high) over {_W} rows between 251 preceding and current row) as high_52, min(low) over {_W} rows between 251 preceding and current row) as low_52, round(avg(volume) over {_W} rows between 19 preceding and current row), 6) + 0.0 as volume_20 from bars qualify ts = max(ts) over (partition by symbol)",
}
