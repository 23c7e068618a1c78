"""Identity, universe, returns, ladder, statistics and quality queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.subjects import continuity, subject_kind_factor
from marketloom.operators import identity as N
from marketloom.operators import indicators as I
from marketloom.operators import quality as Q
from marketloom.operators import stats as T
from marketloom.plans.bars import BARS, HOURS, LIQUID, MONTHS, daily_bars, hourly_bars, liquidity_panel, month_panel, r6
from marketloom.session import clean_key, known, table

def func_subjects(spark, d):
    """O-F1: kind and factor of the event subjects of all return rows."""
    x = table(spark, d, "ret1_1_large_residuals").select("residual_id", "event_subject").distinct()
    kind, factor = subject_kind_factor(F.col("event_subject"))
    return x.select("residual_id", kind.alias("kind"), r6(factor).alias("factor"))


def func_continuity(spark, d):
    """O-F2, O-Q8: whether the price ratio confirms each factor."""
    x = table(spark, d, "id1_later_symbol_ca_resolution").select("res_id", known("factor").alias("f"), known("raw_ratio").alias("r")).distinct().where("f > 0 and r > 0")
    return x.select("res_id", continuity(F.col("r"), F.col("f")).alias("status"))


def func_isclose(spark, d):
    """O-F3: ret_raw rows whose prev_close equals close within a relative tolerance."""
    x = table(spark, d, "ret1_1_large_residuals").select("residual_id", known("prev_close").alias("a"), known("close").alias("b")).distinct()
    return x.where("abs(a - b) <= 1e-8 + 0.0001 * abs(b) and b < double('inf')").select("residual_id")


def id_segments(spark, d):
    """O-S30, O-W11: runs of trading days of suppliers, cut at gaps of more than three sessions."""
    x = liquidity_panel(spark, d).select("entity", F.lit(None).cast("string").alias("isin"), "date")
    s = N.listing_segments(x, key="entity", isin="isin", day="date", max_gap=3)
    return s.select("entity", "part", "first", "last", "n_sessions")


def _links(spark, d, day=None):
    """Segments with their first day, and the links with both ends given; with day only what is known by it.

    Most link ends are missing from id1_segments; they are nodes too, their unknown first day comes last.
    """
    nodes = table(spark, d, "id1_segments").select(clean_key("segment_id").alias("node"), "first")
    links = table(spark, d, "returns_links").select(clean_key("from_segment").alias("a"), clean_key("to_segment").alias("b"), "effective").where("a is not null and b is not null")
    links = links if day is None else links.where(F.col("effective") <= day)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(nodes, "node", "left_anti")
    held = nodes if day is None else nodes.where(F.col("first") <= day)
    return held.unionByName(ends.withColumn("first", F.lit("9999-12-31").cast("date"))), links


def id_entities(spark, d):
    """O-S28: groups of linked segments by smallest key."""
    nodes, links = _links(spark, d)
    return N.entities(nodes.select("node"), links)


def id_entities_as_of(spark, d):
    """O-S28: groups by earliest first day, of segments and links known by a day only."""
    day = F.to_date(F.lit("2020-06-30"))
    nodes, links = _links(spark, d, day)
    return N.entities(nodes, links, first="first", as_of=day)


def pit_universe(spark, d):
    """O-S27, O-W10: suppliers ranked by zero-filled median value over 63 sessions."""
    u = N.universe(liquidity_panel(spark, d), window=63, least_valid=10, top=20)
    return u.select("selection_date", "entity", "valid_sessions", r6(F.col("median_value")).alias("median_value"), F.col("place").cast("bigint").alias("place"), "status")


def ret_adjusted(spark, d):
    """O-S31, O-J8, O-G2: returns with factors of events and their status."""
    b = daily_bars(spark, d).withColumnRenamed("symbol", "entity").withColumnRenamed("ts", "date")
    ev = b.where("volume >= 3").select("entity", F.date_sub("date", 1).alias("ex_date"), F.lit(0.5).alias("factor"))
    x = N.adjusted_returns(b, ev)
    return x.select("entity", "date", r6(F.col("ret_raw")).alias("ret_raw"), F.col("event_factor"), r6(F.col("ret_adj")).alias("ret_adj"), "return_status")


def ret_quality(spark, d):
    """O-G19: rows of each status by entity."""
    return ret_adjusted(spark, d).groupBy("entity", "return_status").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark, d):
    return daily_bars(spark, d).withColumn("c", I.change("close", 1) / 100)


def stat_newey_west(spark, d):
    """O-T2, O-W18: robust mean test of daily changes at lag 4."""
    x = T.newey_west(_changes(spark, d), "symbol", "ts", "c", 4)
    return x.select("symbol", "n", r6(F.col("mean")).alias("mean"), r6(F.col("lrv")).alias("lrv"), r6(F.col("t")).alias("t"))


def stat_sharpe(spark, d):
    """O-T1: annualised Sharpe of daily changes."""
    from marketloom.operators.backtest import sharpe

    return _changes(spark, d).groupBy("symbol").agg(r6(sharpe(F.col("c"))).alias("sharpe"))


def _tests(spark, d):
    """One p-like number for each nation, a ratio of two of its values."""
    return month_panel(spark, d).groupBy(F.col("entity").alias("name")).agg((F.min("value") / F.max("value")).alias("p"))


def stat_multiple(spark, d):
    """O-T9: Holm and Benjamini-Hochberg adjustment."""
    x = T.benjamini_hochberg(T.holm(_tests(spark, d)))
    return x.select("name", r6(F.col("p")).alias("p"), r6(F.col("holm")).alias("holm"), r6(F.col("bh")).alias("bh"))


def stat_deflated(spark, d):
    """O-T11: moments and score of the deflated Sharpe ratio for five trials."""
    x = T.deflated_sharpe(_changes(spark, d), "symbol", "c", 5)
    return x.select("symbol", "n", *[r6(F.col(c)).alias(c) for c in ("sr", "skew", "kurtosis", "z")])


def stat_bootstrap(spark, d):
    """O-T4 to O-T7: block length, one- and two-sided p, bounds and verdict of every symbol's mean daily change."""
    x = T.bootstrap(_changes(spark, d).where("c is not null"), "symbol", "ts", "c", replicates=10_000, seed=20240101)
    return x.select("symbol", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "block", "p_one_sided", "p_two_sided", "lower", "upper")], "verdict")


def stat_randomisation(spark, d):
    """O-T8: share of nations at least as large as the first, with +1 smoothing."""
    x = _tests(spark, d)
    first = x.where("name = 0").select("p").scalar()
    return x.where("name > 0").agg(r6((F.count_if(F.col("p") >= first) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def q_flags(spark, d):
    """O-Q1: flags of daily bars."""
    return Q.bar_flags(daily_bars(spark, d))


def q_defective(spark, d):
    """O-Q2, O-Q3: sessions with a defect and why."""
    return Q.split_defective(hourly_bars(spark, d), [f"{h:02d}:00" for h in range(9, 16)])[1]


def q_merge(spark, d):
    """O-Q4, O-K8: bars after an append-only merge, by symbol."""
    x = daily_bars(spark, d).select("symbol", "ts", "close")
    later = x.where("ts >= date'2000-01-01'").withColumn("close", F.when((F.col("symbol") == "5-LOW") & (F.dayofmonth("ts") == 15), F.col("close") * 1.5).otherwise(F.col("close")))
    merged, _ = Q.merge_bars(x.where("ts < date'2000-07-01'"), later)
    return merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def q_jumps(spark, d):
    """O-Q7, O-J10: large moves and whether a day of heavy trading lies within ten days."""
    b = daily_bars(spark, d)
    x = Q.unexplained_jumps(b, b.where("volume >= 5").select("symbol", F.col("ts").alias("ex_date")))
    return x.select("symbol", "ts", r6(F.col("lr")).alias("lr"), F.col("explained").cast("int").alias("explained"))


def q_fingerprint(spark, d):
    """O-Q5, O-F14: order-insensitive fingerprint of the orders."""
    return Q.fingerprint(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


_NAMES = "func_subjects func_continuity func_isclose id_segments id_entities id_entities_as_of pit_universe ret_adjusted ret_quality stat_newey_west stat_sharpe stat_multiple stat_deflated stat_bootstrap stat_randomisation q_flags q_defective q_merge q_jumps q_fingerprint"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = "(partition by symbol order by ts"
_R = "round({0}, 6) + 0.0 as {0}"
_T = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_KNOWN = "{} <= date '2020-06-30'"
_LINKS = f"""seg as (select {_T.format('segment_id')} as node, first from id1_segments),
ends as (select {_T.format('from_segment')} as a, {_T.format('to_segment')} as b, effective from returns_links),
link as (select distinct a, b from ends where a <> '' and b <> '' and {{known}}),
nodes as (select node, first from seg where {{held}} union all select node, date '9999-12-31' from (select a as node from link union select b from link) where node not in (select node from seg))"""
# minimum labels spread along links until none changes; rank numbers the nodes in the order that decides
_GROUPS = """ranked as (select node, row_number() over (order by {order}) as r from nodes),
e as materialized (select x.r as a, y.r as b from link join ranked x on x.node = link.a join ranked y on y.node = link.b union select y.r, x.r from link join ranked x on x.node = link.a join ranked y on y.node = link.b),
reach as (select r as a, r as b from ranked union select reach.a, e.b from reach join e on e.a = reach.b),
best as (select a, min(b) as g from reach group by 1) select n.node, m.node as entity from best join ranked n on n.r = best.a join ranked m on m.r = best.g"""
_RET = f"""{BARS}, mark as (select symbol, ts, volume from bars), ev as (select symbol, ts - 1 as ex_date from bars where volume >= 3),
x as (select symbol as entity, ts as date, close, lag(ts) over {_W}) as prev_date, lag(close) over {_W}) as prev_close from bars),
hit as (select e.symbol as entity, b.ts as date, count(*) as n from ev e asof join bars b on e.symbol = b.symbol and e.ex_date <= b.ts group by 1, 2),
y as (select x.*, close / prev_close - 1 as ret_raw, case when n is not null then power(0.5::double, n) end as event_factor from x left join hit using (entity, date)),
z as (select *, case when event_factor is null or ret_raw is null then null when abs(ln(event_factor)) < ln(1.25) then 'INCONCLUSIVE' when abs(ln((1 + ret_raw) / event_factor)) < ln(1.25) and abs(ln((1 + ret_raw) / event_factor)) < abs(ln(1 + ret_raw)) then 'VALIDATED' else 'DISCREPANT' end as es from y),
ret as (select *, case when es = 'VALIDATED' then close / (prev_close * event_factor) - 1 end as ret_adj from z),
fin as (select *, case when prev_date is null then 'FIRST_OBSERVATION' when es = 'DISCREPANT' then 'EVENT_DISCREPANT' when es = 'INCONCLUSIVE' then 'EVENT_INCONCLUSIVE' when abs(ln(1 + coalesce(ret_adj, ret_raw))) > ln(1.4) then 'UNEXPLAINED_JUMP' when es = 'VALIDATED' then 'ADJUSTED_VALIDATED' else 'OK' end as return_status from ret)"""
_CH = f"{BARS}, ch as (select symbol, ts, (close / lag(close) over {_W}) - 1) / 100 as c from bars)"
_TESTS = f"{MONTHS}, tests as (select entity as name, min(value) / max(value) as p from months group by 1)"
_LUCKY = (1 - 0.5772156649015329) * T.NORMAL.inv_cdf(0.8) + 0.5772156649015329 * T.NORMAL.inv_cdf(1 - 1 / (5 * math.e))
SQL = {
    "func_subjects": r"""with x as (select distinct residual_id, lower(coalesce(event_subject, '')) as s from ret1_1_large_residuals),
y as (select *, regexp_extract(s, '\bbon(?:us)?\b[^0-9]*([0-9]+) ?: ?([0-9]+)', ['a', 'h']) as b, regexp_extract(s, '(?:\bsplit\b|\bsub-?division\b|\bspl\b)[^0-9]*([0-9.]+)[^0-9]*\bto\b[^0-9]*([0-9.]+)', ['o', 'n']) as p from x),
z as (select *, try_cast(b.a as double) as a, try_cast(b.h as double) as h, try_cast(p.o as double) as o, try_cast(p.n as double) as n from y),
k as (select *, coalesce(a > 0 and h > 0, false) as bonus, coalesce(n > 0 and n < o, false) as split from z),
f as (select residual_id, bonus, split, a, h, o, n, case when contains(s, 'consolidat') then 'CONSOLIDATION' when regexp_matches(s, '\bbon(us)?\b') and regexp_matches(s, 'debenture|preference|\bdvr\b') then 'NON_EQUITY_BONUS' when (regexp_matches(s, '\bsplit|\bsub-?division') and not split) or (regexp_matches(s, '\bbon(us)?\b') and not bonus) then 'UNPARSED_BONUS_SPLIT' when bonus and split then 'BONUS+SPLIT' when bonus then 'BONUS' when split then 'SPLIT' when contains(s, 'right') then 'RIGHTS' when contains(s, 'div') then 'DIVIDEND' else 'OTHER' end as kind from k)
select residual_id, kind, round(case when kind in ('BONUS', 'SPLIT', 'BONUS+SPLIT') then case when bonus then h / (a + h) else 1 end * case when split then n / o else 1 end end, 6) + 0.0 as factor from f""",
    "func_continuity": "with x as (select distinct res_id, factor as f, raw_ratio as r from id1_later_symbol_ca_resolution where factor > 0 and raw_ratio > 0 and not isnan(factor) and not isnan(raw_ratio)) select res_id, case when abs(ln(f)) < ln(1.25) then 'INCONCLUSIVE' when abs(ln(r / f)) < ln(1.25) and abs(ln(r / f)) < abs(ln(r)) then 'VALIDATED' else 'DISCREPANT' end as status from x",
    "func_isclose": "select distinct residual_id from ret1_1_large_residuals where not isnan(prev_close) and not isnan(close) and not isinf(close) and abs(prev_close - close) <= 1e-8 + 0.0001 * abs(close)",
    "id_segments": f"with {LIQUID}, p as (select date, row_number() over (order by date) as pos from (select distinct date from liquid)), a as (select entity, date, coalesce(pos - lag(pos) over (partition by entity order by pos) > 3, true)::int as new from liquid join p using (date)), b as (select *, sum(new) over (partition by entity order by date rows unbounded preceding)::bigint as part from a) select entity, part, min(date) as first, max(date) as last, count(*) as n_sessions from b group by 1, 2",
    "id_entities": f"with recursive {_LINKS.format(known='true', held='true')}, {_GROUPS.format(order='node')}",
    "id_entities_as_of": f"with recursive {_LINKS.format(known=_KNOWN.format('effective'), held=_KNOWN.format('first'))}, {_GROUPS.format(order='first, node')}",
    "pit_universe": f"""with {LIQUID}, p as (select date, row_number() over (order by date) as pos from (select distinct date from liquid)),
ends as (select max(date) as sd, max(pos) as e from p group by date_trunc('month', date) having max(pos) >= 63),
h as (select sd, entity, value, l.date from ends join p on p.pos between e - 62 and e join liquid l on l.date = p.date),
g as (select sd, entity, count(value) as v, bool_or(date = sd) as on_day, list_sort(list(value)) as vs from h group by 1, 2),
m as (select *, case when 31 - (63 - v) >= 0 then vs[31 - (63 - v) + 1] else 0 end as md, case when v < 10 then 'TOO_FEW_SESSIONS' when not on_day then 'NOT_TRADED' end as reason from g),
r as (select *, case when reason is null then row_number() over (partition by sd, reason is null order by md desc, entity) end as place from m)
select sd as selection_date, entity, v as valid_sessions, round(md, 6) + 0.0 as median_value, place, coalesce(reason, case when place <= 20 then 'MEMBER' else 'ELIGIBLE_NOT_SELECTED' end) as status from r""",
    "ret_adjusted": f"with {_RET} select entity, date, {_R.format('ret_raw')}, event_factor, {_R.format('ret_adj')}, return_status from fin",
    "ret_quality": f"with {_RET} select entity, return_status, count(*) as n from fin group by 1, 2",
    "stat_newey_west": f"with {_CH}, x as (select symbol, ts, c, c - avg(c) over (partition by symbol) as d from ch where c is not null), k as (select symbol, c, d * d + " + " + ".join(f"2 * (1 - {k} / 5.0::double) * coalesce(d * lag(d, {k}) over {_W}), 0)" for k in range(1, 5)) + " as t from x), g as (select symbol, count(*) as n, avg(c) as mean, sum(t) / count(*) as lrv from k group by 1) select symbol, n, round(mean, 6) + 0.0 as mean, round(lrv, 6) + 0.0 as lrv, round(mean / sqrt(lrv / n), 6) + 0.0 as t from g",
    "stat_sharpe": f"with {_CH} select symbol, round(avg(c) / stddev_samp(c) * sqrt(252), 6) + 0.0 as sharpe from ch group by 1",
    "stat_multiple": f"with {_TESTS}, r as (select *, row_number() over (order by p, name) as i, count(*) over () as n from tests) select name, round(p, 6) + 0.0 as p, round(least(1, max((n - i + 1) * p) over (order by p, name rows unbounded preceding)), 6) + 0.0 as holm, round(least(1, min(n * p / i) over (order by p, name rows between current row and unbounded following)), 6) + 0.0 as bh from r",
    "stat_deflated": f"with {_CH}, g as (select symbol, count(c) as n, avg(c) as m, stddev_samp(c) as sd, avg(power(c, 2)) as m2, avg(power(c, 3)) as m3, kurtosis_pop(c) + 3 as kurtosis from ch group by 1), s as (select symbol, n, m / sd as sr, (m3 - 3 * m * m2 + 2 * power(m, 3)) / power(m2 - m * m, 1.5) as skew, kurtosis from g) select symbol, n, round(sr, 6) + 0.0 as sr, round(skew, 6) + 0.0 as skew, round(kurtosis, 6) + 0.0 as kurtosis, round((sr - sqrt(1.0 / (n - 1)) * {_LUCKY!r}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, 1e-12)), 6) + 0.0 as z from s",
    "stat_randomisation": f"with {_TESTS} select round((count(*) filter (p >= (select p from tests where name = 0)) + 1) / (count(*) + 1), 6) + 0.0 as p from tests where name > 0",
    "q_flags": f"with {BARS}, x as (select *, ln(close / lag(close) over {_W})) as lr from bars), y as (select *, lead(lr) over {_W}) as nx from x) select 'V04' as rule, symbol, ts from y where high < greatest(open, close) or low > least(open, close) union all select 'V07', symbol, ts from y where abs(lr) > ln(1.3) and abs(lr + nx) < 0.1 and sign(nx) = -sign(lr) union all select 'V09', symbol, ts from y where isodow(ts) >= 6 union all select 'V11', symbol, ts from y where abs(lr) > ln(1.2)",
    "q_defective": f"with {HOURS}, p as (select symbol, session, count(*) filter (time between '09:00' and '15:00') as g from hours group by 1, 2) select symbol, session, 'incomplete' as reasons from p where g < 7",
    "q_merge": f"with {BARS} select symbol, count(*) as n, max(ts) as last from bars where ts < date '2000-07-01' or symbol <> '5-LOW' or not exists (select 1 from bars b where b.symbol = '5-LOW' and day(b.ts) = 15 and b.ts between date '2000-01-01' and date '2000-06-30') group by 1",
    "q_jumps": f"with {BARS}, x as (select symbol, ts, ln(close / lag(close) over {_W})) as lr from bars) select symbol, ts, round(lr, 6) + 0.0 as lr, (exists (select 1 from bars b where b.symbol = x.symbol and b.volume >= 5 and abs(b.ts - x.ts) <= 10))::int as explained from x where abs(lr) > ln(1.4)",
}
