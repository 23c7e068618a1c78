"""Studies, checks and labels built on the other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as I
from marketloom.operators import simulate as R
from marketloom.operators import stats as T
from marketloom.plans.bars import BARS, HOURS, daily_bars, hourly_bars, r6
from marketloom.queries import research, strategies
from marketloom.session import clean_key, known, table


def study_exit_bar(spark, d):
    """O-P16: share of sessions with both late bars, median volume ratio and 90 % gap of their opens in basis points."""
    h = hourly_bars(spark, d)
    at = lambda t, c: F.max(F.when(F.col("time") == t, F.col(c)))
    s = h.groupBy("symbol", "session").agg(at("14:00", "volume").alias("v0"), at("15:00", "volume").alias("v1"), at("14:00", "open").alias("o0"), at("15:00", "open").alias("o1"))
    gap = F.abs(F.try_divide("o1", "o0") - 1) * 10_000
    return s.groupBy("symbol").agg(r6(F.avg((F.col("v0").isNotNull() & F.col("v1").isNotNull()).cast("int"))).alias("both"), r6(F.median(F.try_divide("v1", "v0"))).alias("volume_ratio"), r6(F.percentile(gap, 0.9)).alias("gap_p90"))


def study_parts(spark, d):
    """O-P3, O-K6: mean and deviation of daily changes on three chronological parts."""
    w, all_ = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol")
    x = daily_bars(spark, d).withColumn("c", I.change("close", 1)).withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(all_))
    a, b = F.bround(F.col("n") * 0.5, 0), F.bround(F.col("n") * 0.75, 0)
    x = x.withColumn("part", F.when(F.col("i") <= a, "first").when(F.col("i") <= b, "second").otherwise("third"))
    return x.groupBy("symbol", "part").agg(F.count("c").alias("n"), r6(F.avg("c")).alias("mean"), r6(F.stddev_samp("c")).alias("sd"))


def label_instruments(spark, d):
    """O-B5, O-B9, O-B11, O-F4: instrument by ISIN prefix, a composed label and half-even rounding."""
    s = table(spark, d, "id1_segments")
    kind = F.when(F.coalesce("isin", F.lit("")) == "", "UNKNOWN").when(F.col("isin").startswith("ZZF"), "FUND_UNIT").when(F.col("isin").startswith("ZZE"), "EQUITY").otherwise("OTHER")
    return s.select("segment_id", kind.alias("kind"), F.concat_ws(" ", "symbol", F.when(F.col("removed_on").isNotNull(), "removed")).alias("label"), F.bround(F.col("n_sessions") / 4, 0).cast("long").alias("quarters"))


def compare_reports(spark, d):
    """O-G15, O-G16: strategy return less the benchmark's, from rounded figures, the benchmark's drawdown and Sharpe, and the verdict by margin."""
    from marketloom.operators.backtest import sharpe

    bars = daily_bars(spark, d)
    curve = bars.withColumn("peak", F.max("close").over(I.by_symbol().rowsBetween(*I.UNTIL_NOW))).withColumn("r", I.change("close", 1))
    held = curve.groupBy("symbol").agg((F.min(F.col("close") / F.col("peak") - 1) * 100).alias("dd"), sharpe(F.col("r")).alias("held_sharpe"))
    x = strategies.bt_report(spark, d).join(held, "symbol")
    margin = F.bround("return_pct", 2) - F.bround("buy_hold_pct", 2)
    verdict = F.when(margin > 10, "BEATS").when(margin > 0, "SLIGHTLY_BETTER").otherwise("WORSE")
    return x.select("symbol", margin.cast("decimal(18,2)").cast("double").alias("strategy_minus_benchmark"), r6(F.col("dd")).alias("benchmark_max_dd"), r6(F.col("held_sharpe")).alias("benchmark_sharpe"), verdict.alias("verdict"))


def status_untradable(spark, d):
    """O-G24: sessions by symbol and number of required bars they lack."""
    h = hourly_bars(spark, d)
    n = h.groupBy("symbol", "session").agg(F.count_if(F.col("time").isin(strategies.REQUIRED)).alias("k"))
    return n.groupBy("symbol", (7 - F.col("k")).alias("lacking")).agg(F.count(F.lit(1)).alias("sessions"))


def check_ranks(spark, d):
    """O-P12, O-Q6: selections by pool whose valid ranks are not 1 to n without repeats."""
    u = table(spark, d, "univ1_pit_universe").select("pool", "selection_date", "entity_id", "recorded_on", "univ_id", known("rank").alias("rank"))
    last = u.groupBy("pool", "selection_date", "entity_id").agg(F.max(F.struct("recorded_on", "univ_id", "rank")).alias("x")).where("x.rank >= 1")
    g = last.groupBy("pool", "selection_date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x.rank").alias("k"), F.max("x.rank").alias("top"))
    return g.groupBy("pool").agg(F.count(F.lit(1)).alias("selections"), F.count_if((F.col("n") != F.col("k")) | (F.col("n") != F.col("top"))).alias("irregular"))


def rates_usable(spark, d):
    """O-P13: rates with a value, a basis and a publication on or before their first day, by component."""
    r = table(spark, d, "delivery_nse_eq_s2mom_v1_dated").dropDuplicates(["rate_id"])
    good = known("rate").isNotNull() & F.col("basis").isNotNull()
    return r.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("usable"), F.count_if(F.col("known_on") > F.col("from")).alias("late"), F.count_if(F.col("to").isNull()).alias("open"))


def stat_verdict(spark, d):
    """O-T6, O-T13, O-T15: verdict on each symbol's mean change from its robust t."""
    x = research.stat_newey_west(spark, d)
    z = T.NORMAL.inv_cdf(0.95)
    return x.select("symbol", F.when(F.col("t") > z, "POSITIVE").when(F.col("t") < -z, "NEGATIVE").otherwise("INCONCLUSIVE").alias("verdict"))


def stat_detectable(spark, d):
    """O-T10, O-T12: least mean change that a test of 5 % finds with power 80 %, without showing the mean."""
    k = T.NORMAL.inv_cdf(0.95) + T.NORMAL.inv_cdf(0.8)
    x = daily_bars(spark, d).withColumn("c", I.change("close", 1))
    return x.groupBy("symbol").agg(F.count("c").alias("n"), r6(F.stddev_samp("c") / F.sqrt(F.count("c")) * k).alias("detectable"))


def baseline_random_entry(spark, d):
    """O-S13: distribution of gross results of random entries between 10:00 and 14:00."""
    return R.random_entry(hourly_bars(spark, d), first="10:00", last="14:00", exit_time="15:00", replicates=200)


def reference_months(spark, d):
    """O-F6, O-F10, O-J24: references of the flags by month and weekday of their day."""
    f = table(spark, d, "id1_flags").select("flag_id", clean_key("segment_id").alias("s"), "flagged_on").distinct()
    return f.groupBy(F.trunc("flagged_on", "MM").alias("month"), F.weekday("flagged_on").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("with_segment"))


_NAMES = "study_exit_bar study_parts label_instruments compare_reports status_untradable check_ranks rates_usable stat_verdict stat_detectable baseline_random_entry reference_months"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = "(partition by symbol order by ts"
_K = T.NORMAL.inv_cdf(0.95) + T.NORMAL.inv_cdf(0.8)
SQL = {
    "study_exit_bar": f"with {HOURS}, s as (select symbol, session, max(volume) filter (time = '14:00') as v0, max(volume) filter (time = '15:00') as v1, max(open) filter (time = '14:00') as o0, max(open) filter (time = '15:00') as o1 from hours group by 1, 2) select symbol, round(avg((v0 is not null and v1 is not null)::int), 6) + 0.0 as both, round(quantile_cont(v1::double / v0, 0.5), 6) + 0.0 as volume_ratio, round(quantile_cont(abs(o1 / nullif(o0, 0) - 1) * 10000, 0.9), 6) + 0.0 as gap_p90 from s group by 1",
    "study_parts": f"with {BARS}, r as (select symbol, close / lag(close) over {_W}) - 1 as c, row_number() over {_W}) as i, count(*) over (partition by symbol) as n from bars), p as (select symbol, c, case when i <= round_even(n * 0.5, 0) then 'first' when i <= round_even(n * 0.75, 0) then 'second' else 'third' end as part from r) select symbol, part, count(c) as n, round(avg(c), 6) + 0.0 as mean, round(stddev_samp(c), 6) + 0.0 as sd from p group by 1, 2",
    "label_instruments": "select segment_id, case when coalesce(isin, '') = '' then 'UNKNOWN' when starts_with(isin, 'ZZF') then 'FUND_UNIT' when starts_with(isin, 'ZZE') then 'EQUITY' else 'OTHER' end as kind, concat_ws(' ', symbol, case when removed_on is not null then 'removed' end) as label, round_even(n_sessions / 4.0::double, 0)::bigint as quarters from id1_segments",
    "compare_reports": f"with rep as ({strategies.SQL['bt_report']}), {BARS}, b as (select symbol, ts, close, max(close) over {_W} rows unbounded preceding) as peak, close / lag(close) over {_W}) - 1 as r from bars), h as (select symbol, min(close / peak - 1) * 100 as dd, avg(r) / stddev_samp(r) * sqrt(252) as sh from b group by 1), m as (select symbol, round_even(return_pct, 2) - round_even(buy_hold_pct, 2) as m from rep) select symbol, m::decimal(18,2)::double as strategy_minus_benchmark, round(dd, 6) + 0.0 as benchmark_max_dd, round(sh, 6) + 0.0 as benchmark_sharpe, case when m > 10 then 'BEATS' when m > 0 then 'SLIGHTLY_BETTER' else 'WORSE' end as verdict from m join h using (symbol)",
    "status_untradable": f"with {HOURS}, n as (select symbol, session, count(*) filter (time between '09:00' and '15:00') as k from hours group by 1, 2) select symbol, 7 - k as lacking, count(*) as sessions from n group by 1, 2",
    "check_ranks": "with l as (select * from univ1_pit_universe qualify row_number() over (partition by pool, selection_date, entity_id order by recorded_on desc, univ_id desc) = 1), g as (select pool, selection_date, count(*) as n, count(distinct rank) as k, max(rank) as top from l where rank >= 1 and not isnan(rank) group by 1, 2) select pool, count(*) as selections, count(*) filter (n <> k or n <> top) as irregular from g group by 1",
    "rates_usable": "with r as (select distinct on (rate_id) * from delivery_nse_eq_s2mom_v1_dated) select component, count(*) as rows, count(*) filter (rate is not null and not isnan(rate) and basis is not null) as usable, count(*) filter (known_on > \"from\") as late, count(*) filter (\"to\" is null) as open from r group by 1",
    "stat_verdict": f"select symbol, case when t > {T.NORMAL.inv_cdf(0.95)!r} then 'POSITIVE' when t < -{T.NORMAL.inv_cdf(0.95)!r} then 'NEGATIVE' else 'INCONCLUSIVE' end as verdict from ({research.SQL['stat_newey_west']})",
    "stat_detectable": f"with {BARS}, r as (select symbol, close / lag(close) over {_W}) - 1 as c from bars) select symbol, count(c) as n, round(stddev_samp(c) / sqrt(count(c)) * {_K!r}, 6) + 0.0 as detectable from r group by 1",
    "reference_months": "with f as (select distinct flag_id, trim(segment_id, ' ' || chr(9) || chr(10) || chr(13)) as s, flagged_on from id1_flags) select date_trunc('month', flagged_on)::date as month, (isodow(flagged_on) - 1)::int as weekday, count(*) as n, count(nullif(s, '')) as with_segment from f group by 1, 2",
}
