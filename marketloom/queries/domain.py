"""Identity, cost and regime operators over the domain's own tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as I
from marketloom.operators import simulate as R
from marketloom.operators.pit import periods_in_force
from marketloom.plans.bars import BARS, LIQUID, daily_bars, liquidity_panel, r6
from marketloom.queries import strategies
from marketloom.session import clean_key, known, table


def _orders(spark, d):
    cols = ["order_id", "portfolio", "s_plus", "weight_change", "notional_rs"]
    return table(spark, d, "step_e").select(*cols).distinct().where("s_plus is not null")


def ledger_orders(spark, d):
    """O-S25, O-J9: cost of each order by the dated rate of each component, capped per order."""
    o, rates = _orders(spark, d), table(spark, d, "delivery_nse_eq_s2mom_v1_dated")
    hit = periods_in_force(o, rates, event_id="order_id", event_day="s_plus", component="component", start="from", end="to", known_from="known_on", row_id="rate_id")
    terms = rates.select("rate_id", "rate", known("cap_rs_per_order").alias("cap")).dropDuplicates(["rate_id"])
    value = F.abs("weight_change") * F.col("notional_rs")
    x = hit.join(terms, "rate_id").join(o.where("not isnan(weight_change) and not isnan(notional_rs)"), "order_id")
    return x.select("order_id", "component", (F.round(F.least(value * F.col("rate"), F.coalesce("cap", F.lit(float("inf")))), 8) + F.lit(0.0)).alias("cost_rs"))


def ledger_monthly(spark, d):
    """O-G17, O-S26: traded value and orders by portfolio and month."""
    o = _orders(spark, d).where("not isnan(weight_change) and not isnan(notional_rs)")
    return o.groupBy("portfolio", F.date_format("s_plus", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("weight_change") < 0).alias("n_sold"), r6(F.sum(F.abs(F.col("weight_change").cast("decimal(20,10)"))).cast("double")).alias("traded")
    )


def id_rollup(spark, d):
    """O-G20, O-G3, O-P10: each entity's span, symbols, ISINs and instrument type by precedence."""
    s = table(spark, d, "id1_segments")
    kind = F.when(F.bool_or(F.col("instrument_type") == "FUND_UNIT"), "FUND_UNIT").when(F.bool_or(F.col("instrument_type") == "EQUITY"), "EQUITY").otherwise(F.min("instrument_type"))
    return s.groupBy("entity_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"), F.array_join(F.sort_array(F.collect_set("isin")), ",").alias("isins"), kind.alias("instrument_type"), F.count(F.lit(1)).alias("n_segments"))


def id_resolve(spark, d):
    """O-J15, O-Q9: the one entity that carried a symbol on a day, or why there is none."""
    q = table(spark, d, "id1_later_symbol_ca_resolution").select("res_id", F.upper(clean_key("symbol")).alias("sym"), "ex_date").distinct()
    s = table(spark, d, "id1_segments").select("entity_id", F.col("symbol").alias("sym"), "first", "last")
    j = q.join(s, (q.sym == s.sym) & (s["first"] <= q.ex_date) & (q.ex_date <= s["last"]), "left")
    g = j.groupBy("res_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"))
    return g.select("res_id", F.when(F.col("n") == 0, "UNRESOLVED_NO_ENTITY").when(F.col("n") > 1, "UNRESOLVED_AMBIGUOUS").otherwise("RESOLVED").alias("resolution"), F.when(F.col("n") == 1, F.col("one")).alias("entity_id"))


def id_links_evidence(spark, d):
    """O-S30, O-J12, O-J13: neighbouring segments of an entity and what links them."""
    w = Window.partitionBy("entity_id").orderBy("first", "segment_id")
    s = table(spark, d, "id1_segments")
    x = s.select("entity_id", F.lag("segment_id").over(w).alias("from_segment"), F.col("segment_id").alias("to_segment"), F.lag("symbol").over(w).alias("s0"), "symbol", F.lag("isin").over(w).alias("i0"), "isin", F.datediff("first", F.lag("last").over(w)).alias("gap")).where("from_segment is not null")
    kind = F.when(F.col("i0") == F.col("isin"), F.when(F.col("s0") == F.col("symbol"), "ISIN_SAME").otherwise("SYMBOL_CHANGE")).when(F.col("i0").isNull() & F.col("isin").isNotNull(), "ISIN_INTRO").when(F.col("s0") == F.col("symbol"), "ISIN_CHANGE").otherwise("BOTH")
    return x.select("from_segment", "to_segment", kind.alias("evidence"), (F.col("gap") <= 5).cast("int").alias("adjacent"))


def id_last_before(spark, d):
    """O-J16: of each nation's suppliers the one whose last day is the latest up to a record's day."""
    life = liquidity_panel(spark, d).groupBy("entity").agg(F.max("date").alias("last"))
    x = life.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("entity") == F.col("s_suppkey"))
    rec = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.expr("date_add(date'2001-10-20', cast(n_nationkey % 10 as int))").alias("day"))
    w = Window.partitionBy("s_nationkey").orderBy(F.col("last").desc(), "entity")
    return x.join(rec, "s_nationkey").where("last <= day").withColumn("i", F.row_number().over(w)).where("i = 1").select("s_nationkey", "day", "entity")


def regime_labels(spark, d):
    """O-S29: calm or wild, up or down, from what was known the row before."""
    w = I.by_symbol()
    x = daily_bars(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(w)))
    x = x.withColumn("vol", I.full_window(F.stddev_samp, F.col("lr"), 20, w)).withColumn("trend", I.change("close", 20))
    x = I.expanding_median(x.select("symbol", "ts", "vol", "trend"), "vol", "mid")
    x = x.select("symbol", "ts", F.lag("vol").over(w).alias("v"), F.lag("mid").over(w).alias("m"), F.lag("trend").over(w).alias("t")).where("v is not null and t is not null")
    return x.select("symbol", "ts", F.when(F.col("v") > F.col("m"), "HIGH").otherwise("LOW").alias("volatility"), F.when(F.col("t") > 0, "UP").otherwise("DOWN").alias("trend"))


def describe_series(spark, d):
    """O-G21, O-G23: mean, deviation, positive share, worst drawdown of the compounded changes."""
    w = I.by_symbol()
    x = daily_bars(spark, d).withColumn("r", I.change("close", 1) / 100).where("r is not null")
    x = x.withColumn("wealth", F.product(1 + F.col("r")).over(w.rowsBetween(*I.UNTIL_NOW)))
    x = x.withColumn("dd", I.drawdown("wealth"))
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("mean"), r6(F.stddev_samp("r")).alias("sd"), r6(F.avg((F.col("r") > 0).cast("int"))).alias("positive"), r6(F.min("dd")).alias("max_drawdown"))


def flag_counts(spark, d):
    """O-G8, O-P6, O-P15: flags by kind and year, segments that hold several."""
    f = table(spark, d, "id1_flags").select("flag_id", clean_key("segment_id").alias("s"), "flag", "flagged_on").distinct()
    return f.groupBy("flag", F.year("flagged_on").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("n_segments"))


def universe_turnover(spark, d):
    """O-K9, O-P11, O-J7: members of each selection of a pool that were not members a month before."""
    u = table(spark, d, "univ1_pit_universe").select("pool", "selection_date", "entity_id", "recorded_on", "univ_id", F.upper(F.btrim("status", F.lit(" \t\r\n"))).alias("status"))
    last = u.groupBy("pool", "selection_date", "entity_id").agg(F.max(F.struct("recorded_on", "univ_id", "status")).alias("x")).where("x.status = 'MEMBER'")
    now = last.select("pool", "entity_id", F.date_format("selection_date", "yyyy-MM").alias("month"))
    before = last.select("pool", "entity_id", F.date_format(F.add_months(F.trunc("selection_date", "MM"), 1), "yyyy-MM").alias("month")).distinct()
    return now.join(before, ["pool", "entity_id", "month"], "left_anti").groupBy("pool", "month").agg(F.count_distinct("entity_id").alias("entered"))


def baseline_sign_flip(spark, d):
    """O-S12, O-T8: how often coin-flipped sides do at least as well as the signals."""
    x = R.sign_flip(strategies._trades(spark, d), key=["symbol", "session", "entry_time"], replicates=2000, seed=7)
    return x.select(r6(F.col("observed")).alias("observed"), "replicates", "at_least", r6(F.col("p")).alias("p"))


_NAMES = "ledger_orders ledger_monthly id_rollup id_resolve id_links_evidence id_last_before regime_labels describe_series flag_counts universe_turnover baseline_sign_flip"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = "(partition by symbol order by ts"
_T = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_O = "o as (select distinct order_id, portfolio, s_plus, weight_change, notional_rs from step_e where s_plus is not null)"
_SD = f"case when count(lr) over {_W} rows between 19 preceding and current row) = 20 then stddev_samp(lr) over {_W} rows between 19 preceding and current row) end"
SQL = {
    "ledger_orders": f"with {_O}, c as (select o.*, d.component, d.rate, d.cap_rs_per_order as cap, row_number() over (partition by o.order_id, d.component order by d.known_on desc, d.rate_id desc) as n from o join (select distinct * from delivery_nse_eq_s2mom_v1_dated) d on d.\"from\" <= o.s_plus and (d.\"to\" is null or o.s_plus <= d.\"to\") and d.known_on <= o.s_plus) select order_id, component, round(least(abs(weight_change) * notional_rs * rate, case when cap is null or isnan(cap) then 'inf'::double else cap end), 8) + 0.0 as cost_rs from c where n = 1 and weight_change is not null and notional_rs is not null and not isnan(weight_change) and not isnan(notional_rs)",
    "ledger_monthly": f"with {_O} select portfolio, strftime(s_plus, '%Y-%m') as month, count(*) as n_orders, count(*) filter (weight_change < 0) as n_sold, round(sum(abs(weight_change::decimal(20,10)))::double, 6) + 0.0 as traded from o where not isnan(weight_change) and not isnan(notional_rs) group by 1, 2",
    "id_rollup": "select entity_id, min(first) as first, max(last) as last, coalesce(string_agg(distinct symbol, ',' order by symbol), '') as symbols, coalesce(string_agg(distinct isin, ',' order by isin), '') as isins, case when bool_or(instrument_type = 'FUND_UNIT') then 'FUND_UNIT' when bool_or(instrument_type = 'EQUITY') then 'EQUITY' else min(instrument_type) end as instrument_type, count(*) as n_segments from id1_segments group by 1",
    "id_resolve": f"with q as (select distinct res_id, upper({_T.format('symbol')}) as sym, ex_date from id1_later_symbol_ca_resolution), g as (select res_id, count(distinct s.entity_id) as n, min(s.entity_id) as one from q left join id1_segments s on s.symbol = q.sym and s.first <= q.ex_date and q.ex_date <= s.last group by 1) select res_id, case when n = 0 then 'UNRESOLVED_NO_ENTITY' when n > 1 then 'UNRESOLVED_AMBIGUOUS' else 'RESOLVED' end as resolution, case when n = 1 then one end as entity_id from g",
    "id_links_evidence": "with x as (select segment_id as to_segment, symbol, isin, lag(segment_id) over w as from_segment, lag(symbol) over w as s0, lag(isin) over w as i0, first - lag(last) over w as gap from id1_segments window w as (partition by entity_id order by first, segment_id)) select from_segment, to_segment, case when i0 = isin then case when s0 = symbol then 'ISIN_SAME' else 'SYMBOL_CHANGE' end when i0 is null and isin is not null then 'ISIN_INTRO' when s0 = symbol then 'ISIN_CHANGE' else 'BOTH' end as evidence, (gap <= 5)::int as adjacent from x where from_segment is not null",
    "id_last_before": f"with {LIQUID}, l as (select entity, s_nationkey, max(date) as last from liquid join supplier on s_suppkey = entity group by 1, 2), r as (select n_nationkey as k, date '2001-10-20' + (n_nationkey % 10)::int as day from nation) select s_nationkey, day, entity from l join r on k = s_nationkey where last <= day qualify row_number() over (partition by s_nationkey order by last desc, entity) = 1",
    "regime_labels": f"with {BARS}, a as (select *, ln(close / lag(close) over {_W})) as lr from bars), b as (select symbol, ts, {_SD} as vol, close / lag(close, 20) over {_W}) - 1 as trend from a), c as (select *, quantile_cont(vol, 0.5) over {_W} rows unbounded preceding) as mid from b), e as (select symbol, ts, lag(vol) over {_W}) as v, lag(mid) over {_W}) as m, lag(trend) over {_W}) as t from c) select symbol, ts, case when v > m then 'HIGH' else 'LOW' end as volatility, case when t > 0 then 'UP' else 'DOWN' end as trend from e where v is not null and t is not null",
    "describe_series": f"with {BARS}, a as (select symbol, ts, (close / lag(close) over {_W}) - 1) / 100 as r from bars), b as (select *, product(1 + r) over {_W} rows unbounded preceding) as wealth from a where r is not null), c as (select *, wealth / max(wealth) over {_W} rows unbounded preceding) - 1 as dd from b) select symbol, count(*) as n, round(avg(r), 6) + 0.0 as mean, round(stddev_samp(r), 6) + 0.0 as sd, round(avg((r > 0)::int), 6) + 0.0 as positive, round(min(dd), 6) + 0.0 as max_drawdown from c group by 1",
    "flag_counts": f"with f as (select distinct flag_id, {_T.format('segment_id')} as s, flag, flagged_on from id1_flags) select flag, year(flagged_on)::int as y, count(*) as n, count(distinct nullif(s, '')) as n_segments from f group by 1, 2",
    "universe_turnover": "with l as (select * from univ1_pit_universe qualify row_number() over (partition by pool, selection_date, entity_id order by recorded_on desc, univ_id desc) = 1), m as (select distinct pool, entity_id, date_trunc('month', selection_date)::date as m from l where upper(trim(status)) = 'MEMBER') select pool, strftime(m, '%Y-%m') as month, count(distinct entity_id) as entered from m where not exists (select 1 from m b where b.pool = m.pool and b.entity_id = m.entity_id and b.m + interval 1 month = m.m) group by 1, 2",
}
