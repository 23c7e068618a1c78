"""The ladder of portfolios and its costs, over nations as entities and shipped value as what is traded.

An entity's price is the mean of its last 20 days of shipped value; a day of four times that mean
carries an event with factor 0.5; a market day that opens a month on a weekend is a special
session, which is no row of the panel.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import costs as C
from marketloom.operators import identity as N
from marketloom.operators import ladder as L
from marketloom.operators import stats as T
from marketloom.plans.bars import r6
from marketloom.session import cut_lineage, table

SIZE, WINDOW, LEAST, FIXED_ON, PRIMARY_UNTIL = 15, 63, 20, "2001-06-30", "1999-12-31"
POOL = "entity % 5 != 4"


def _values(spark, d):
    """entity, date, value: shipped value of each nation's suppliers by day."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("entity"))
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    return x.groupBy("k", "date").agg(F.sum("v").alias("v")).join(s, "k").groupBy("entity", "date").agg(F.sum("v").cast("decimal(18,2)").alias("value"))


def _special(c):
    return (F.dayofmonth(c) == 1) & (F.weekday(c) >= 5)


def _graded(x):
    """Return rows of the panel, from its values, with their status."""
    days = x.select("date").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    days = days.withColumn("specials", F.sum(_special("date").cast("int")).over(order)).withColumn("pos", F.row_number().over(order))
    w = Window.partitionBy("entity").orderBy("date")
    last = w.rowsBetween(-19, 0)
    x = x.where(~_special("date")).join(days, "date")
    x = x.withColumn("close", F.sum("value").over(last).cast("double") / F.count(F.lit(1)).over(last))
    x = x.withColumn("event_factor", F.when(F.col("value").cast("double") > 4 * F.col("close"), 0.5))
    x = x.withColumn("prev_close", F.lag("close").over(w)).withColumn("gap", F.col("pos") - F.lag("pos").over(w)).withColumn("spans", F.col("specials") - F.lag("specials").over(w))
    x = x.withColumn("ret_raw", F.try_divide("close", "prev_close") - 1)
    status = (
        F.when(F.col("prev_close").isNull(), "FIRST_OBSERVATION")
        .when(F.col("spans") > 0, "SPECIAL_SESSION_SPAN")
        .when(F.col("event_factor").isNotNull(), "EVENT_DISCREPANT")
        .when(F.col("gap") > 6, "MULTI_SESSION_GAP")
        .when(F.abs(F.log1p("ret_raw")) > F.log(F.lit(1.4)), "UNEXPLAINED_JUMP")
        .otherwise("OK")
    )
    return x.select("entity", "date", "close", "prev_close", "ret_raw", "event_factor", F.lit(None).cast("double").alias("ret_adj"), status.alias("return_status"))


def _panel(values):
    return L.study_panel(_graded(values))


def _months(values):
    days = values.select("date").distinct().where(~_special("date"))
    return L.calendar(days, primary_until=F.to_date(F.lit(PRIMARY_UNTIL)))


def _ranked(values):
    x = values.where(~_special("date")).select("entity", "date", F.col("value").cast("double").alias("value"))
    u = N.universe(x, window=WINDOW, least_valid=LEAST, top=SIZE)
    return u.where("place is not null").select(F.col("selection_date").alias("t"), "entity", "place")


def _universes(ranked):
    return L.universes(ranked, F.expr(POOL), size=SIZE, fixed_on=F.to_date(F.lit(FIXED_ON)))


class _Ladder:
    """The tables of a ladder, each written once, as the next ones read them several times."""

    def __init__(self, spark, d):
        self.values = cut_lineage(_values(spark, d))
        self.months = cut_lineage(_months(self.values))
        self.ranked = cut_lineage(_ranked(self.values))
        self.universe = cut_lineage(_universes(self.ranked))
        self.panel = cut_lineage(_panel(self.values))
        self.form()

    def form(self, **treatment):
        """Scores and members under a treatment of the panel."""
        self.treated = L.treated(self.panel, **treatment)
        self.scores = cut_lineage(L.formations(self.universe, self.treated, self.months))
        self.members = cut_lineage(L.legs(self.scores))
        return self

    def held(self, **kw):
        return L.holdings(self.members, self.treated, self.months, **kw)

    def results(self, **kw):
        return L.monthly(self.held(**kw), self.members, self.scores, self.universe, self.months)


def ladder_calendar(spark, d):
    """O-S14: t, m12, m1, the session after t, the one after the next month's end, holding month and sample."""
    return _months(_values(spark, d))


def ladder_universes(spark, d):
    """O-S15, O-K1: the universes of steps A (fixed), B (pool) and C (all) of every month."""
    return _universes(cut_lineage(_ranked(_values(spark, d))))


def study_panel(spark, d):
    """O-S16: naive, graded and raw return of every row, its class and whether its raw return stands."""
    x = _panel(_values(spark, d))
    return x.select("entity", "date", *[r6(F.col(c)).alias(c) for c in ("r_naive", "r_rg", "r_raw")], "cls", F.col("raw_ok").cast("int").alias("raw_ok"))


def ladder_treated(spark, d):
    """O-S17: rows by class, untreated and with spans and event-free gaps at their raw return."""
    p = cut_lineage(_panel(_values(spark, d)))
    named = lambda x, n: x.select(F.lit(n).alias("treatment"), "cls", "r_rg")
    both = named(p, "none").unionByName(named(L.treated(p, span_raw=True), "span")).unionByName(named(L.treated(p, gap_raw=True), "gap"))
    return both.groupBy("treatment", "cls").agg(F.count(F.lit(1)).alias("n"), F.count("r_rg").alias("with_return"))


def ladder_formation(spark, d):
    """O-S18, O-W8: growth of the rankable members of every step over (m12, m1]."""
    return _Ladder(spark, d).scores.select("step", "t", "entity", r6(F.col("score")).alias("score"))


def ladder_legs(spark, d):
    """O-K3, O-K4: winners, losers and everyone of every step and month."""
    return _Ladder(spark, d).members


def ladder_holding(spark, d):
    """O-S19 to O-S21: worth of every holding at the end of its month."""
    x = _Ladder(spark, d).held()
    return x.select("step", "t", "leg", "entity", r6(F.col("value")).alias("value"), "filled", "alone", "spans", "booked", F.col("gone").cast("int").alias("gone"))


def ladder_gaps(spark, d):
    """O-S21: members without a row at the exit session and the row booked for them, if any."""
    x = _Ladder(spark, d)
    x = L.gap_bookings(x.members.where("step in ('C', 'D')"), x.panel, x.months)
    return x.select("step", "t", "leg", "entity", "booked", r6(F.col("r_raw")).alias("r_raw"), F.col("raw_ok").cast("int").alias("raw_ok"))


def ladder_fill_shares(spark, d):
    """O-P14: share of stock-days filled, filled without others, and at a span, by leg of the graded step."""
    x = _Ladder(spark, d)
    held = x.held().where("step = 'D'").groupBy("leg").agg(F.sum("filled").alias("filled"), F.sum("alone").alias("alone"), F.sum("spans").alias("spans"))
    days = x.members.where("step = 'D'").join(x.panel.join(L._periods(x.panel, x.months), "date"), ["entity", "t"]).groupBy("leg").agg(F.count(F.lit(1)).alias("stock_days"))
    share = lambda c: r6(F.try_divide(c, "stock_days")).alias(f"{c}_share")
    return days.join(held, "leg").select("leg", "stock_days", share("filled"), share("alone"), share("spans"))


def ladder_run(spark, d):
    """O-S22: every month of every step with its status, sizes and returns."""
    x = _Ladder(spark, d).results()
    return x.select("t", "holding_month", "sample", "step", "status", "n_universe", "n_rankable", "k", *[r6(F.col(c)).alias(c) for c in ("W", "L", "BM", "WML")])


def ladder_delta(spark, d):
    """O-S23, O-G18: WML of step A less step D by month in per cent, or why there is none."""
    x = L.paired_delta(_Ladder(spark, d).results())
    return x.select("t", "holding_month", "sample", r6(F.col("delta")).alias("delta"), F.col("paired").cast("int").alias("paired"), "reason")


def ladder_sensitivity(spark, d):
    """O-T15: mean paired delta under each treatment of spans, gaps and flagged days, and whether its sign flips."""
    x = _Ladder(spark, d)
    delta = lambda name, **kw: cut_lineage(L.paired_delta(x.results(**kw)).select(F.lit(name).alias("treatment"), "delta"))
    out = delta("PRIMARY").unionByName(delta("MISS_RAW", missing="RAW")).unionByName(delta("MISS_ZERO", missing="ZERO"))
    for name, treatment in (("SPAN_RAW", {"span_raw": True}), ("GAP_RAW", {"gap_raw": True})):
        x.form(**treatment)
        out = out.unionByName(delta(name))
    g = out.groupBy("treatment").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"))
    first = F.max(F.when(F.col("treatment") == "PRIMARY", F.col("mean"))).over(Window.partitionBy(F.lit(0)))
    return g.select("treatment", "n", r6(F.col("mean")).alias("mean_delta"), (F.signum("mean") != F.signum(first)).cast("int").alias("flips"))


def ladder_halves(spark, d):
    """O-T17: paired delta in both halves of the sample and pooled: n, mean, deviation, least month."""
    x = L.paired_delta(_Ladder(spark, d).results()).where("paired")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    part = F.explode(F.array(F.when(F.col("i") <= F.floor(F.col("n") / 2), "first").otherwise("second"), F.lit("pooled")))
    return x.select(part.alias("block"), "t", "delta").groupBy("block").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta")).alias("mean"), r6(F.stddev_samp("delta")).alias("sd"), F.min_by("t", F.struct("delta", "t")).alias("worst"))


def _orders(x: _Ladder):
    orders = L.rebalances(cut_lineage(L.weights(x.held())), x.months).join(x.months.select("t", "s_plus"), "t")
    return cut_lineage(C.order_costs(orders.join(x.ranked, ["t", "entity"], "left"), C.schedule(x.months.sparkSession)))


def cost_orders(spark, d):
    """O-S25, O-J9, O-J18: every order with its dated charges, tax, depository charge, slippage band and cost."""
    x = _orders(_Ladder(spark, d))
    return x.select("step", "t", "leg", "entity", "side", r6(F.col("weight_change")).alias("weight_change"), *[r6(F.col(c)).alias(c) for c in ("order_value_rs", "tax_base_rs", "indirect_tax_rs", "dp_charge_rs", "total_cost_rs")], "slippage_band", F.col("band_fallback").cast("int").alias("band_fallback"))


def cost_monthly(spark, d):
    """O-G17: costs, orders, sales and traded value of each rebalance, also outside the first band."""
    x = C.monthly_costs(_orders(_Ladder(spark, d)))
    return x.select("step", "t", "leg", "n_orders", "n_sold", "n_fallback", *[r6(F.col(c)).alias(c) for c in ("traded_fraction", "traded_fraction_low", "cost_fraction", "cost_fraction_S2", "cost_fraction_S4")])


def _net(spark, d):
    x = _Ladder(spark, d)
    return cut_lineage(C.net_returns(x.results().where("step = 'D'"), C.monthly_costs(_orders(x)).where("step = 'D'")))


def cost_net(spark, d):
    """O-S24, O-S26: gross and net return of every month and leg of step D under five slippages, turnover, and the net WML."""
    x = _net(spark, d)
    cols = [c for c in x.columns if c not in ("t", "step")]
    return x.select("t", *[r6(F.col(c)).alias(c) for c in cols])


def cost_break_even(spark, d):
    """O-T13: one-sided test of the net excess of W over BM and its break-even cost in basis points, or why there is none."""
    x = _net(spark, d)
    test = T.newey_west(x.select(F.lit("W").alias("leg"), "t", (F.col("net_W_S0") - F.col("net_BM_S0")).alias("x")), "leg", "t", "x", 4)
    traded = x.agg((F.avg("traded_fraction_W") - F.avg("traded_fraction_BM")).alias("d"))
    both = test.join(traded)
    status = F.when((F.col("d") <= 0) & (F.col("mean") <= 0), "NO_BREAK_EVEN FAILS_S0").when(F.col("d") <= 0, "NO_BREAK_EVEN").when(F.col("mean") <= 0, "FAILS_S0").otherwise("OK")
    supported = (F.col("mean") > 0) & (F.col("t") > T.NORMAL.inv_cdf(0.95))
    return both.select("n", r6(F.col("mean")).alias("mean_excess"), r6(F.col("t")).alias("t"), r6(F.col("d")).alias("traded"), supported.cast("int").alias("supported"), status.alias("status"), r6(F.when(status == "OK", F.col("mean") / F.col("d") * 10_000)).alias("break_even_bps"))


_NAMES = "ladder_calendar ladder_universes study_panel ladder_treated ladder_formation ladder_legs ladder_holding ladder_gaps ladder_fill_shares ladder_run ladder_delta ladder_sensitivity ladder_halves cost_orders cost_monthly cost_net cost_break_even"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_W = "(partition by entity order by date"
_PANEL = f"""val as materialized (select s_nationkey as entity, l_shipdate::date as date, sum(l_extendedprice::decimal(18,2)) as value from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
alldays as materialized (select *, sum(sp) over (order by date rows unbounded preceding) as specials, row_number() over (order by date) as pos from (select distinct date, (day(date) = 1 and isodow(date) >= 6)::int as sp from val)),
px as materialized (select entity, date, value, specials, pos, sum(value) over {_W} rows between 19 preceding and current row)::double / count(*) over {_W} rows between 19 preceding and current row) as close from val join alldays using (date) where sp = 0),
pv as (select *, case when value::double > 4 * close then 0.5::double end as f, lag(close) over {_W}) as prev, pos - lag(pos) over {_W}) as gap, specials - lag(specials) over {_W}) as spans, close / lag(close) over {_W}) - 1 as raw from px),
st as materialized (select *, case when prev is null then 'FIRST_OBSERVATION' when spans > 0 then 'SPECIAL_SESSION_SPAN' when f is not null then 'EVENT_DISCREPANT' when gap > 6 then 'MULTI_SESSION_GAP' when abs(ln(1 + raw)) > ln(1.4) then 'UNEXPLAINED_JUMP' else 'OK' end as status from pv),
panel0 as materialized (select entity, date, case when f is not null then close / (prev * f) - 1 else raw end as r_naive, case when status = 'OK' then raw end as r_rg, raw as r_raw, case status when 'SPECIAL_SESSION_SPAN' then 'SPAN' when 'OK' then 'OK' when 'FIRST_OBSERVATION' then 'FIRST' else 'BAD' end as cls, f is null and coalesce(abs(ln(1 + raw)) <= ln(1.4), false) as raw_ok, status = 'MULTI_SESSION_GAP' and f is null as gap_free from st)"""
_TREATED = {"": "false", "SPAN_RAW": "cls = 'SPAN'", "GAP_RAW": "gap_free"}
_CAL = f"""mm as materialized (select date_trunc('month', date)::date as m, max(date) as t, min(date) as first from alldays where sp = 0 group by 1),
cal as materialized (select a.t, (select t from mm b where b.m = a.m - interval 12 month) as m12, (select t from mm b where b.m = a.m - interval 1 month) as m1, (select min(first) from mm b where b.m > a.m) as s_plus,
  (select (select min(first) from mm c where c.m > b.m) from mm b where b.m = a.m + interval 1 month) as s_pp, strftime(a.m + interval 1 month, '%Y-%m') as holding_month, case when a.t <= date '{PRIMARY_UNTIL}' then 'PRIMARY' else 'OOS' end as sample from mm a)"""
_UNI = f"""up as (select date, row_number() over (order by date) as pos from alldays where sp = 0),
uends as (select max(date) as sd, max(pos) as e from up group by date_trunc('month', date) having max(pos) >= {WINDOW}),
uh as (select sd, entity, value::double as value, px.date from uends join up on up.pos between e - {WINDOW - 1} and e join px on px.date = up.date),
ug as (select sd, entity, count(value) as v, bool_or(date = sd) as on_day, list_sort(list(value)) as vs from uh group by 1, 2),
um as (select sd as t, entity, case when {WINDOW // 2} - ({WINDOW} - v) >= 0 then vs[{WINDOW // 2} - ({WINDOW} - v) + 1] else 0 end as md from ug where v >= {LEAST} and on_day),
ur as materialized (select t, entity, row_number() over (partition by t order by md desc, entity) as place from um),
uc as (select 'C' as universe, t, entity from ur where place <= {SIZE} union all select 'B', t, entity from (select *, row_number() over (partition by t order by place) as i from ur where entity % 5 <> 4) where i <= {SIZE}),
uni as materialized (select * from uc union all select 'A', m.t, entity from uc, (select distinct t from ur) m where universe = 'B' and uc.t = date '{FIXED_ON}')"""


def _ladder(treatment: str = "", missing: str = "coalesce(mean, 0)") -> str:
    use = _TREATED[treatment]
    return f"""{_PANEL}, {_CAL}, {_UNI},
panel as materialized (select entity, date, r_naive, case when {use} then r_raw else r_rg end as r_rg, r_raw, case when {use} then 'OK' else cls end as cls, raw_ok, gap_free from panel0),
cs as materialized (select entity, date, sum(case when cls = 'FIRST' then 0 else coalesce(ln(1 + r_naive), 0) end) over {_W} rows unbounded preceding) as n, sum(case when cls = 'OK' then coalesce(ln(1 + r_rg), 0) else 0 end) over {_W} rows unbounded preceding) as g, sum((cls in ('BAD', 'FIRST'))::int) over {_W} rows unbounded preceding) as bad from panel),
steps as (select * from (values ('A', 'A', false, false), ('B', 'B', false, false), ('C', 'C', false, true), ('D', 'C', true, true)) v(step, universe, rg, delists)),
want as materialized (select step, cal.t, entity, rg, delists, m12, m1 from uni join steps using (universe) join cal on cal.t = uni.t),
fa as materialized (select want.*, n as an, g as ag, bad as abad from want join cs on cs.entity = want.entity and cs.date = want.m12),
fb as materialized (select fa.*, n as bn, g as bg, bad as bbad from fa join cs on cs.entity = fa.entity and cs.date = fa.m1),
score as materialized (select step, t, entity, rg, delists, case when rg then exp(bg - ag) - 1 else exp(bn - an) - 1 end as score from fb where not rg or abad = bbad),
rk as materialized (select *, row_number() over (partition by step, t order by score desc, entity) as i, count(*) over (partition by step, t) as n from score),
mem as materialized (select step, t, entity, rg, delists, 'W' as leg from rk where i <= floor(n * 0.3 + 0.5) union all select step, t, entity, rg, delists, 'L' from rk where i > n - floor(n * 0.3 + 0.5) union all select step, t, entity, rg, delists, 'BM' from rk),
hm as materialized (select mem.*, s_plus, s_pp from mem join cal using (t) where s_plus is not null and s_pp is not null),
gone as materialized (select hm.*, (select min(p.date) from panel p where p.entity = hm.entity and p.date > s_pp) as booked from hm anti join panel p on p.entity = hm.entity and p.date = hm.s_pp where delists),
gaps as materialized (select gone.*, p.r_naive, p.r_raw, p.raw_ok from gone left join panel p on p.entity = gone.entity and p.date = booked),
used as materialized (select step, leg, entity, booked as date, min(t) as since from gaps where booked is not null group by 1, 2, 3, 4),
hd as materialized (select hm.*, p.date, r_naive, r_rg, r_raw, cls, coalesce(since < hm.t, false) as spent from hm join panel p on p.entity = hm.entity and p.date > s_plus and p.date <= s_pp left join used on used.step = hm.step and used.leg = hm.leg and used.entity = hm.entity and used.date = p.date),
hx as materialized (select *, cls = 'OK' and not spent as ok, rg and cls in ('BAD', 'FIRST') and not spent as bad, avg(r_rg) filter (cls = 'OK' and not spent) over (partition by step, t, leg, date) as mean from hd),
hg as materialized (select step, t, leg, entity, product(1 + case when rg then case when ok then r_rg when bad then {missing} else 0 end when spent or cls = 'FIRST' then 0 else coalesce(r_naive, 0) end) as v, count(*) filter (bad) as filled, count(*) filter (bad and mean is null) as alone, count(*) filter (rg and cls = 'SPAN') as spans, count(*) as stock_days from hx group by 1, 2, 3, 4),
hold as materialized (select hm.step, hm.t, hm.leg, hm.entity, coalesce(v, 1) * case when gaps.t is null then 1 when gaps.booked is null then 0.7::double else 1 + coalesce(case when hm.rg then r_raw else r_naive end, 0) end as value, coalesce(filled, 0) as filled, coalesce(alone, 0) as alone, coalesce(spans, 0) as spans, coalesce(stock_days, 0) as stock_days, booked, gaps.t is not null and booked is null as gone
  from hm left join hg on hg.step = hm.step and hg.t = hm.t and hg.leg = hm.leg and hg.entity = hm.entity left join gaps on gaps.step = hm.step and gaps.t = hm.t and gaps.leg = hm.leg and gaps.entity = hm.entity),
res0 as materialized (select step, cal.*, (select count(*) from uni where uni.universe = steps.universe and uni.t = cal.t) as n_universe, (select count(*) from rk where rk.step = steps.step and rk.t = cal.t) as n_rankable, (select count(*) from mem where mem.step = steps.step and mem.t = cal.t and leg = 'W') as k from steps, cal),
hs as materialized (select step, t, avg(value) filter (leg = 'W') - 1 as w, avg(value) filter (leg = 'L') - 1 as l, avg(value) filter (leg = 'BM') - 1 as bm from hold group by 1, 2),
res as materialized (select r.step, r.t, holding_month, sample, case when m12 is null or m1 is null then 'NO_FORMATION_DATA' when k = 0 then 'NO_RANKABLE_STOCKS' when s_plus is null or s_pp is null then 'NO_HOLDING_DATA' else 'OK' end as status, n_universe, n_rankable, k, w, l, bm from res0 r left join hs on hs.step = r.step and hs.t = r.t where n_universe > 0),
delta as (select t, holding_month, sample, coalesce(max(status) filter (step = 'A'), 'NOT_RUN') as sa, coalesce(max(status) filter (step = 'D'), 'NOT_RUN') as sd, max(w - l) filter (step = 'A') as wa, max(w - l) filter (step = 'D') as wd from res group by 1, 2, 3),
paired as (select t, holding_month, sample, sa = 'OK' and sd = 'OK' as paired, case when sa = 'OK' and sd = 'OK' then (wa - wd) * 100 end as delta, case when sa = 'OK' and sd = 'OK' then '' else 'A:' || sa || ' D:' || sd end as reason from delta)"""


_LADDER = _ladder()
_COSTS = f"""{_LADDER}, {C.SCHEDULE_SQL},
wt as materialized (select *, 1.0::double / count(*) over (partition by step, t, leg) as bw, value / sum(value) over (partition by step, t, leg) as ew from hold),
nx as materialized (select wt.*, n.t as nt from wt join cal c using (t) join cal n on date_trunc('month', n.t) = date_trunc('month', c.t) + interval 1 month),
oj as (select coalesce(a.step, b.step) as step, coalesce(a.t, b.nt) as t, coalesce(a.leg, b.leg) as leg, coalesce(a.entity, b.entity) as entity, coalesce(a.bw, 0) - coalesce(b.ew, 0) as dw from wt a full join nx b on a.step = b.step and a.t = b.nt and a.leg = b.leg and a.entity = b.entity),
od as materialized (select oj.*, s_plus, abs(dw) * {C.NOTIONAL} as v, dw > 0 as buy, ur.place from oj join (select distinct step, t, leg from wt) using (step, t, leg) join cal using (t) left join ur on ur.t = oj.t and ur.entity = oj.entity where dw <> 0),
ch as (select od.*, {', '.join(f"(select rate from schedule where component = '{c}' and s_plus between since and until) as {c}" for c in C.COMPONENTS)}, (select cap from schedule where component = 'brokerage' and s_plus between since and until) as cap from od),
cb as (select *, case when buy then v * stt_buy else v * stt_sell end as stt, case when buy then v * stamp_duty_buy else 0 end as stamp, v * exchange_txn + v * sebi_fee + least(v * brokerage, cap) as base, case when buy then 0 else dp_charge end as dp from ch),
oc as materialized (select *, stt + stamp + base + base * indirect_tax + dp as total, case when place <= {C.TOP_PLACE} then '{C.TOP}' else '{C.LOW}' end as band, coalesce(place > {C.LOW_PLACE}, true) as fallback from cb),
mc as materialized (select step, t, leg, count(*) as n_orders, count(*) filter (not buy) as n_sold, count(*) filter (fallback) as n_fallback, sum(abs(dw)) as tf, sum(case when band = '{C.LOW}' then abs(dw) else 0 end) as tfl, sum(total) / {C.NOTIONAL} as cf, {', '.join(f"sum(total + v * case when band = '{C.TOP}' then {a} else {b} end / 10000.0::double) / {C.NOTIONAL} as cf_{s}" for s, (a, b) in C.SLIPPAGE_BPS.items())} from oc group by 1, 2, 3),
mp as materialized (select t, {', '.join(f"coalesce(max({c}) filter (leg = '{p}'), 0) as {c}_{p}" for p in ('W', 'L', 'BM') for c in ('tf', *[f'cf_{s}' for s in C.SLIPPAGE_BPS]))} from mc where step = 'D' group by t),
net as materialized (select res.t, w, l, bm, mp.* exclude (t) from res left join mp on mp.t = res.t where step = 'D' and status = 'OK')"""
_R = "round({0}, 6) + 0.0 as {1}"
_NET_COLS = [
    *[("w" if p == "W" else "l" if p == "L" else "bm", f"gross_{p}") for p in ("W", "L", "BM")],
    ("w - l", "gross_WML"),
    *[(f"{'w' if p == 'W' else 'l' if p == 'L' else 'bm'} - coalesce(cf_{s}_{p}, 0)", f"net_{p}_{s}") for s in C.SLIPPAGE_BPS for p in ("W", "L", "BM")],
    *[(f"w - l - coalesce(cf_{s}_W, 0) - coalesce(cf_{s}_L, 0)", f"net_WML_{s}") for s in C.SLIPPAGE_BPS],
    *[(f"coalesce(tf_{p}, 0)", f"traded_fraction_{p}") for p in ("W", "L", "BM")],
    *[(f"coalesce(tf_{p}, 0) / 2", f"turnover_{p}") for p in ("W", "L", "BM")],
]
SQL = {
    "ladder_calendar": f"with {_PANEL}, {_CAL} select * from cal",
    "ladder_universes": f"with {_PANEL}, {_UNI} select universe, t, entity from uni",
    "study_panel": f"with {_PANEL} select entity, date, " + ", ".join(_R.format(c, c) for c in ("r_naive", "r_rg", "r_raw")) + ", cls, raw_ok::int as raw_ok from panel0",
    "ladder_treated": f"with {_PANEL} select 'none' as treatment, cls, count(*) as n, count(r_rg) as with_return from panel0 group by 2 union all select 'span', case when cls = 'SPAN' then 'OK' else cls end, count(*), count(case when cls = 'SPAN' then r_raw else r_rg end) from panel0 group by 2 union all select 'gap', case when gap_free then 'OK' else cls end, count(*), count(case when gap_free then r_raw else r_rg end) from panel0 group by 2",
    "ladder_formation": f"with {_LADDER} select step, t, entity, {_R.format('score', 'score')} from score",
    "ladder_legs": f"with {_LADDER} select step, t, entity, leg from mem",
    "ladder_holding": f"with {_LADDER} select step, t, leg, entity, {_R.format('value', 'value')}, filled, alone, spans, booked, gone::int as gone from hold",
    "ladder_gaps": f"with {_LADDER} select step, t, leg, entity, booked, {_R.format('r_raw', 'r_raw')}, raw_ok::int as raw_ok from gaps",
    "ladder_fill_shares": f"with {_LADDER} select leg, sum(stock_days)::bigint as stock_days, " + ", ".join(f"round(sum({c}) / sum(stock_days), 6) + 0.0 as {c}_share" for c in ("filled", "alone", "spans")) + " from hold where step = 'D' group by 1",
    "ladder_run": f"with {_LADDER} select t, holding_month, sample, step, status, n_universe, n_rankable, k, " + ", ".join(f"round(case when status = 'OK' then {e} end, 6) + 0.0 as {n}" for e, n in (("w", "W"), ("l", "L"), ("bm", "BM"), ("w - l", "WML"))) + " from res",
    "ladder_delta": f"with {_LADDER} select t, holding_month, sample, {_R.format('delta', 'delta')}, paired::int as paired, reason from paired",
    "ladder_sensitivity": "with a as (" + " union all ".join(f"select '{n}' as treatment, count(delta) as n, avg(delta) as m from (with {_ladder(*a)} select * from paired)" for n, a in (("PRIMARY", ()), ("SPAN_RAW", ("SPAN_RAW",)), ("GAP_RAW", ("GAP_RAW",)), ("MISS_RAW", ("", "coalesce(r_raw, 0)")), ("MISS_ZERO", ("", "0")))) + ") select treatment, n, round(m, 6) + 0.0 as mean_delta, (sign(m) <> sign((select m from a where treatment = 'PRIMARY')))::int as flips from a",
    "ladder_halves": f"with {_LADDER}, o as (select t, delta, row_number() over (order by t) as i, count(*) over () as n from paired where paired), b as (select case when i <= n // 2 then 'first' else 'second' end as block, t, delta from o union all select 'pooled', t, delta from o) select block, count(*) as n, round(avg(delta), 6) + 0.0 as mean, round(stddev_samp(delta), 6) + 0.0 as sd, arg_min(t, (delta, t)) as worst from b group by 1",
    "cost_orders": f"with {_COSTS} select step, t, leg, entity, case when buy then 'BUY' else 'SELL' end as side, {_R.format('dw', 'weight_change')}, {_R.format('v', 'order_value_rs')}, {_R.format('base', 'tax_base_rs')}, {_R.format('base * indirect_tax', 'indirect_tax_rs')}, {_R.format('dp', 'dp_charge_rs')}, {_R.format('total', 'total_cost_rs')}, band as slippage_band, fallback::int as band_fallback from oc",
    "cost_monthly": f"with {_COSTS} select step, t, leg, n_orders, n_sold, n_fallback, {_R.format('tf', 'traded_fraction')}, {_R.format('tfl', 'traded_fraction_low')}, {_R.format('cf', 'cost_fraction')}, {_R.format('cf_S2', 'cost_fraction_S2')}, {_R.format('cf_S4', 'cost_fraction_S4')} from mc",
    "cost_net": f"with {_COSTS} select t, " + ", ".join(_R.format(e, n) for e, n in _NET_COLS) + " from net",
    "cost_break_even": f"with {_COSTS}, x as (select t, (w - coalesce(cf_S0_W, 0)) - (bm - coalesce(cf_S0_BM, 0)) as x, coalesce(tf_W, 0) as a, coalesce(tf_BM, 0) as b from net), y as (select *, x - avg(x) over () as d from x), z as (select *, d * d + " + " + ".join(f"2 * (1 - {k} / 5.0::double) * coalesce(d * lag(d, {k}) over (order by t), 0)" for k in range(1, 5)) + f" as lv from y), g as (select count(*) as n, avg(x) as mean, avg(x) / sqrt(sum(lv) / count(*) / count(*)) as t, avg(a) - avg(b) as d from z) select n, {_R.format('mean', 'mean_excess')}, {_R.format('t', 't')}, {_R.format('d', 'traded')}, (mean > 0 and t > {T.NORMAL.inv_cdf(0.95)!r})::int as supported, case when d <= 0 and mean <= 0 then 'NO_BREAK_EVEN FAILS_S0' when d <= 0 then 'NO_BREAK_EVEN' when mean <= 0 then 'FAILS_S0' else 'OK' end as status, round(case when d > 0 and mean > 0 then mean / d * 10000 end, 6) + 0.0 as break_even_bps from g",
}
