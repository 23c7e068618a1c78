"""Joins, aggregates, top-k and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import joins as J
from marketloom.plans.bars import BARS, HOURS, LIQUID, MONTHS, daily_bars, hourly_bars, liquidity_panel, month_panel, r6
from marketloom.session import table


def _errors(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.select("event_id", "user_id", F.to_date("ts").alias("ex_date"))


def _sessions(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select("user_id", F.to_date("ts").alias("date")).distinct()


def join_equi_inner(spark, d):
    """O-J1, O-J2: bars of two symbols on the same day."""
    x = daily_bars(spark, d).select("symbol", "ts", "close")
    a, b = x.where("symbol like '1-%'").select("ts", F.col("close").alias("close_old")), x.where("symbol like '2-%'").select("ts", F.col("close").alias("close_new"))
    return a.join(b, "ts").select("ts", "close_old", "close_new")


def join_one_to_one(spark, d):
    """O-J3: order totals joined one to one with their customers' keys."""
    o = table(spark, d, "orders")
    return J.require_one_to_one(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_custkey"), ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_custkey")


def join_left(spark, d):
    """O-J4, O-J24: every customer with the number of their orders."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def join_align_days(spark, d):
    """O-J5: closes of all symbols on the days they share."""
    x = daily_bars(spark, d)
    wide = x.groupBy("ts").pivot("symbol", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.first("close"))
    cols = ["urgent", "high", "medium", "unspecified", "low"]
    return wide.toDF("ts", *cols).dropna()


def join_anti_semi(spark, d):
    """O-J6, O-J7: users with errors and no purchase, and users with both."""
    e = table(spark, d, "events")
    errors, bought = e.where("event_type = 'error'").select("user_id").distinct(), e.where("event_type = 'purchase'").select("user_id").distinct()
    return errors.join(bought, "user_id", "left_anti").withColumn("kind", F.lit("only")).unionByName(errors.join(bought, "user_id", "left_semi").withColumn("kind", F.lit("both")))


def join_asof_forward(spark, d):
    """O-J8: errors attached to the user's first click day on or after them."""
    return J.asof_forward(_errors(spark, d), _sessions(spark, d), "user_id", "ex_date", "date").select("event_id", "user_id", "ex_date", "matched_day")


RATES = [("stt", "1990-01-01", "1996-12-31", 0.001), ("stt", "1997-01-01", None, 0.0005), ("stamp", "1990-01-01", "1998-06-30", 0.0002), ("stamp", "1998-07-01", None, 0.0001)]
_RATES_SQL = "rates as (select * from (values " + ", ".join(f"('{c}', date '{a}', {'null' if b is None else f"date '{b}'"}, {r}::double)" for c, a, b, r in RATES) + ") t(component, \"from\", \"to\", rate))"


def _rates(spark):
    return spark.createDataFrame(RATES, "component string, from string, to string, rate double").select("component", F.to_date("from").alias("from"), F.to_date("to").alias("to"), "rate")


def join_interval(spark, d):
    """O-J9: dated rates in force on each day, one per component."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    facts = days.withColumn("component", F.explode(F.array(F.lit("stt"), F.lit("stamp"))))
    return J.interval_lookup(facts, _rates(spark), "component", "day", "from", "to", "rate").select("component", "day", "rate")


def join_band(spark, d):
    """O-J10: whether a user's error has a purchase within two days."""
    bought = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return J.near_in_time(_errors(spark, d), bought, "user_id", "ex_date", "day", 2, "explained").select("event_id", F.col("explained").cast("int").alias("explained"))


def join_before_after(spark, d):
    """O-J11, O-J21: the user's last click day before and first one on or after each error, the latter within 10 days."""
    e, s = _errors(spark, d).distinct(), _sessions(spark, d)
    marks = s.select("user_id", F.col("date").alias("day")).withColumn("mark", F.col("day"))
    asks = e.select("user_id", "event_id", F.col("ex_date").alias("day"))
    both = asks.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("user_id").orderBy(F.datediff("day", F.to_date(F.lit("1970-01-01"))))
    x = both.withColumn("t0", F.max("mark").over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("t1", F.min("mark").over(w.rangeBetween(0, 10)))
    return x.where("event_id is not null").select("event_id", "t0", "t1")


def join_theta_change(spark, d):
    """O-J12: suppliers of one nation whose last shipping day precedes another's first by at most 30 days."""
    life = liquidity_panel(spark, d).groupBy("entity").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    x = life.join(s, life.entity == s.s_suppkey).select("entity", "s_nationkey", "first", "last")
    a, b = x.select(F.col("entity").alias("old"), "s_nationkey", "last"), x.select(F.col("entity").alias("new"), F.col("s_nationkey").alias("n"), "first")
    return a.join(b, (a.s_nationkey == b.n) & (a.old != b.new) & (F.abs(F.datediff(b["first"], F.add_months(a["last"], -82))) <= 2)).select("old", "new", F.lit("SYMBOL_CHANGE").alias("evidence"))


def join_jump_pairs(spark, d):
    """O-J14: a jump beyond ln 1.4 and its reversal within 2 to 20 rows of the same symbol.

    Rows are numbered and bucketed by 20, so a reversal lies in its jump's bucket or the next one.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    x = daily_bars(spark, d).select("symbol", "ts", F.row_number().over(w).alias("i"), F.log(F.col("close") / F.lag("close").over(w)).alias("lr")).where(F.abs("lr") > F.log(F.lit(1.4)))
    x = x.withColumn("k", F.floor(F.col("i") / 20))
    a, b = x.withColumn("k", F.explode(F.array("k", F.col("k") + 1))).alias("a"), x.alias("b")
    c = F.col
    j = a.join(b, (c("a.symbol") == c("b.symbol")) & (c("a.k") == c("b.k")) & (c("b.i") - c("a.i") > 1) & (c("b.i") - c("a.i") <= 20) & (F.signum("b.lr") == -F.signum("a.lr")) & (F.abs(c("a.lr") + c("b.lr")) < 0.15))
    return j.select(c("a.symbol").alias("symbol"), c("a.ts").alias("jump"), c("b.ts").alias("reversal"))


def join_contains(spark, d):
    """O-J15, O-J16: the one error-free span of a user that contains each purchase."""
    e = table(spark, d, "events").where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = e.withColumn("span", F.count_if(F.col("event_type") == "error").over(w))
    return x.where("event_type = 'purchase'").select("event_id", "span")


def join_gap_exists(spark, d):
    """O-J17: whether the market held a session without the symbol between two of its rows."""
    x = daily_bars(spark, d)
    days = x.select("ts").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")))
    w = Window.partitionBy("symbol").orderBy("ts")
    return x.join(days, "ts").select("symbol", "ts", F.coalesce(F.col("pos") - F.lag("pos").over(w) > 1, F.lit(False)).cast("int").alias("spans_gap"))


def join_outer_align(spark, d):
    """O-J18: change of each customer's order count from 1996 to 1997, missing = 0."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return J.align_outer(o.where("y = 1997").select("o_custkey", "n"), o.where("y = 1996").select("o_custkey", "n"), ["o_custkey"], "n").select("o_custkey", "target", "held", "change")


def join_densify(spark, d):
    """O-J19: nation and month grid with zeros, and months that had a value."""
    p = month_panel(spark, d)
    months = p.select(F.collect_set("month")).scalar()  # no more than calendar months
    grid = p.select("entity").distinct().select("entity", F.explode(months).alias("month"))
    full = grid.join(p, ["entity", "month"], "left")
    return full.groupBy("entity").agg(r6(F.expr("percentile(coalesce(value, 0), 0.5)")).alias("median"), F.count("value").alias("valid"))


def join_frame_diff(spark, d):
    """O-J22, O-P18: fields that differ between bars by first key and bars by total price."""
    x = daily_bars(spark, d)
    y = x.withColumn("close", F.greatest("close", F.col("open"))).where("volume > 1")
    return J.frame_difference(x, y, ["symbol", "ts"], ["open", "close"])


def join_cross_check(spark, d):
    """O-J23: hourly against daily totals of events: presence, range and volume."""
    h = hourly_bars(spark, d).groupBy("symbol", "session").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.sum("volume").alias("v"))
    o = table(spark, d, "events").where("value > 1").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("session")).agg(F.max("value").alias("oh"), F.min("value").alias("ol"), F.count(F.lit(1)).alias("ov"))
    j = h.join(o, ["symbol", "session"], "full_outer")
    flag = F.when(F.col("h").isNull() | F.col("oh").isNull(), "C1").when((F.col("h") > F.col("oh") * 1.0001) | (F.col("l") < F.col("ol") * 0.9999), "C2").when(~F.try_divide("ov", "v").between(0.5, 1.05), "C3").otherwise("OK")
    return j.select("symbol", "session", flag.alias("flag"))


def agg_group(spark, d):
    """O-G1, O-G4, O-G6: spans and distinct counts by customer."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("n_priorities"))


def agg_product(spark, d):
    """O-G2, O-G3: product of discounts and sorted distinct flags by order."""
    x = table(spark, d, "lineitem")
    return x.groupBy("l_orderkey").agg(r6(F.product(1 - F.col("l_discount"))).alias("factor"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), "+").alias("flags"))


def agg_conditional(spark, d):
    """O-G5, O-Q2: quality counts of bars by symbol."""
    x = daily_bars(spark, d)
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("impossible"), F.count_if(F.col("volume") == 1).alias("thin"), F.count_if(F.weekday("ts") >= 5).alias("weekend"))


def agg_bool(spark, d):
    """O-G7: customers all of whose orders are finished, and any open."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").cast("int").alias("all_finished"), F.bool_or(F.col("o_orderstatus") == "O").cast("int").alias("any_open"))


def agg_value_counts(spark, d):
    """O-G8: orders by status and priority."""
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def agg_sets(spark, d):
    """O-G9: event types of a user in the first and not in the second half of the month."""
    e = table(spark, d, "events")
    x = e.groupBy("user_id").agg(F.collect_set(F.when(F.dayofmonth("ts") <= 15, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.dayofmonth("ts") > 15, F.col("event_type"))).alias("b"))
    return x.select("user_id", F.array_join(F.sort_array(F.array_except("a", "b")), ",").alias("lost"), F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("kept"))


def agg_quantiles(spark, d):
    """O-G10: exact quartiles of order value by priority."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(*[r6(F.expr(f"percentile(o_totalprice, {p})")).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9)])


def agg_ohlc(spark, d):
    """O-G11, O-G12: hourly bars of events."""
    return hourly_bars(spark, d).select("symbol", "session", "time", "open", "high", "low", "close", "volume")


def agg_pivot(spark, d):
    """O-G18: order counts by status, wide."""
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0).toDF("y", "f", "o", "p")


def agg_skew(spark, d):
    """O-G25: unbiased skewness of monthly value and the worst month of each nation."""
    p = month_panel(spark, d).groupBy("entity").agg(F.skewness("value").alias("g"), F.count(F.lit(1)).alias("n"), F.min_by("month", F.struct("value", "month")).alias("worst"))
    n = F.col("n")
    return p.select("entity", r6(F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), "worst")


def agg_calendar(spark, d):
    """O-G22, O-F8: weekdays of 1996 without an order, by month."""
    days = spark.sql("select explode(sequence(date'1996-01-01', date'1996-12-31', interval 1 day)) as day").where("weekday(day) < 5")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.join(o, "day", "left_anti").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("missing"))


def top_tie_break(spark, d):
    """O-K1, O-K2: the three most valuable nations of each month, ties by key."""
    w = Window.partitionBy("month").orderBy(F.col("value").desc(), "entity")
    return month_panel(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 3").select("month", "place", "entity")


def top_proportional(spark, d):
    """O-K3, O-K4: the best and worst 30 % of each month's nations."""
    w = Window.partitionBy("month").orderBy(F.col("value").desc(), "entity")
    x = month_panel(spark, d).select("month", "entity", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("month")).alias("n"))
    x = x.withColumn("k", F.floor(F.col("n") * 0.3 + 0.5))
    return x.select("month", "entity", F.when(F.col("i") <= F.col("k"), "W").when(F.col("i") > F.col("n") - F.col("k"), "L").alias("leg")).where("leg is not null")


def top_tail(spark, d):
    """O-K5, O-P2: the last 20 bars of every symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return daily_bars(spark, d).withColumn("i", F.row_number().over(w)).where("i <= 20").select("symbol", "ts", "close")


def split_chronological(spark, d):
    """O-K6: 50/25/25 split of each symbol's days, bounds rounded half to even."""
    w, all_ = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol")
    x = daily_bars(spark, d).select("symbol", "ts", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(all_).alias("n"))
    a, b = F.bround(F.col("n") * 0.5, 0), F.bround(F.col("n") * 0.75, 0)
    x = x.withColumn("part", F.when(F.col("i") <= a, "train").when(F.col("i") <= b, "validate").otherwise("test"))
    return x.groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def set_upsert(spark, d):
    """O-K7, O-K8, O-K10: union of two extracts, the newest order of a customer and day wins."""
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    both = o.where("o_orderkey % 2 = 0").unionByName(o)
    best = both.groupBy("o_custkey", "day").agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("x"))
    return best.select("o_custkey", "day", "x.o_orderkey", "x.o_totalprice")


def set_operations(spark, d):
    """O-K9: nations of suppliers and customers: shared, and months with and without orders in two priorities."""
    x = daily_bars(spark, d)
    a, b = x.where("symbol = '1-URGENT'").select("ts"), x.where("symbol = '5-LOW'").select("ts")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).withColumn("kind", F.lit("first"))).unionByName(b.exceptAll(a).withColumn("kind", F.lit("second")))


def project_downsample(spark, d):
    """O-B10: every k-th bar, k = rows // 300, at least 1."""
    w, all_ = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol")
    x = daily_bars(spark, d).select("symbol", "ts", "close", (F.row_number().over(w) - 1).alias("i"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(all_) / 300)).alias("k"))
    return x.where("i % k = 0").select("symbol", "ts", "close")


def project_classify(spark, d):
    """O-B4, O-B6, O-B8: ordered labels of orders by day and value."""
    o = table(spark, d, "orders")
    label = F.when(F.weekday("o_orderdate") >= 5, "WEEKEND").when(F.col("o_totalprice") > 200000, "TOP").when(F.col("o_totalprice") < 20000, "LOW").otherwise("MID")
    return o.groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def filter_exclusions(spark, d):
    """O-B1, O-B3: rows before the cutoff and outside reviewed intervals, by symbol."""
    x = daily_bars(spark, d).where("ts < date'2000-01-01'")
    ex = spark.createDataFrame([("1-URGENT", "1996-01-01", "1996-03-31"), ("5-LOW", "1997-06-01", "1997-06-30")], "symbol string, d0 string, d1 string").select("symbol", F.to_date("d0").alias("d0"), F.to_date("d1").alias("d1"))
    kept = x.join(ex, (x.symbol == ex.symbol) & (x.ts >= ex.d0) & (x.ts < F.date_add(ex.d1, 1)), "left_anti")
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def service_watchlist(spark, d):
    """O-P1: last close, change on the row before, and whether the symbol is stale."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    x = daily_bars(spark, d).withColumn("i", F.row_number().over(w)).where("i <= 2")
    g = x.groupBy("symbol").agg(F.max(F.when(F.col("i") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("i") == 2, F.col("close"))).alias("prev"), F.max("ts").alias("ts")).where("prev is not null")
    return g.select("symbol", "ts", "last", r6((F.col("last") / F.col("prev") - 1) * 100).alias("change_pct"), (F.datediff(F.to_date(F.lit("2001-08-15")), "ts") > 30).cast("int").alias("stale"))


def json_nested(spark, d):
    """O-F13, O-A11: sum of the number in each event's JSON by type."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"), F.count("props").alias("n"))


_NAMES = "join_equi_inner join_one_to_one join_left join_align_days join_anti_semi join_asof_forward join_interval join_band join_before_after join_theta_change join_jump_pairs join_contains join_gap_exists join_outer_align join_densify join_frame_diff join_cross_check agg_group agg_product agg_conditional agg_bool agg_value_counts agg_sets agg_quantiles agg_ohlc agg_pivot agg_skew agg_calendar top_tie_break top_proportional top_tail split_chronological set_upsert set_operations project_downsample project_classify filter_exclusions service_watchlist json_nested"
QUERIES = {n: globals()[n] for n in _NAMES.split()}
_E = "err as (select event_id, user_id, ts::date as ex_date from events where event_type = 'error'), ses as (select distinct user_id, ts::date as date from events where event_type = 'click')"
_PIV = ", ".join(f"max(close) filter (symbol = '{s}') as {n}" for s, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low")))
SQL = {
    "join_equi_inner": f"with {BARS} select a.ts, a.close as close_old, b.close as close_new from bars a join bars b on a.ts = b.ts where a.symbol like '1-%' and b.symbol like '2-%'",
    "join_one_to_one": "select o_orderkey, o_totalprice, o_custkey from orders",
    "join_left": "select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by 1",
    "join_align_days": f"with {BARS}, w as (select ts, {_PIV} from bars group by ts) select * from w where urgent is not null and high is not null and medium is not null and unspecified is not null and low is not null",
    "join_anti_semi": "with e as (select user_id, bool_or(event_type = 'error') as a, bool_or(event_type = 'purchase') as b from events group by 1) select user_id, case when b then 'both' else 'only' end as kind from e where a",
    "join_asof_forward": f"with {_E} select event_id, e.user_id, ex_date, s.date as matched_day from err e asof join ses s on e.user_id = s.user_id and e.ex_date <= s.date",
    "join_interval": f"with {_RATES_SQL} select component, day, rate from (select distinct o_orderdate::date as day from orders) join rates on day >= \"from\" and (\"to\" is null or day <= \"to\")",
    "join_band": f"with {_E}, p as (select distinct user_id, ts::date as day from events where event_type = 'purchase') select event_id, (exists (select 1 from p where p.user_id = err.user_id and abs(p.day - err.ex_date) <= 2))::int as explained from err",
    "join_before_after": f"with {_E} select event_id, (select max(date) from ses where ses.user_id = err.user_id and date < ex_date) as t0, (select min(date) from ses where ses.user_id = err.user_id and date >= ex_date and date <= ex_date + 10) as t1 from err",
    "join_theta_change": f"with {LIQUID}, x as (select entity, s_nationkey as n, min(date) as first, max(date) as last from liquid join supplier on s_suppkey = entity group by 1, 2) select a.entity as old, b.entity as new, 'SYMBOL_CHANGE' as evidence from x a join x b on a.n = b.n and a.entity <> b.entity and abs(b.first - (a.last - interval 82 month)::date) <= 2",
    "join_jump_pairs": f"with {BARS}, x as (select symbol, ts, row_number() over w as i, ln(close / lag(close) over w) as lr from bars window w as (partition by symbol order by ts)), j as (select * from x where abs(lr) > ln(1.4)) select a.symbol, a.ts as jump, b.ts as reversal from j a join j b on a.symbol = b.symbol and b.i - a.i between 2 and 20 and sign(a.lr) = -sign(b.lr) and abs(a.lr + b.lr) < 0.15",
    "join_contains": "with e as (select *, count(*) filter (event_type = 'error') over (partition by user_id order by ts, event_id rows unbounded preceding) as span from events where event_type in ('error', 'purchase')) select event_id, span from e where event_type = 'purchase'",
    "join_gap_exists": f"with {BARS}, p as (select ts, row_number() over (order by ts) as pos from (select distinct ts from bars)) select symbol, ts, coalesce(pos - lag(pos) over (partition by symbol order by ts) > 1, false)::int as spans_gap from bars join p using (ts)",
    "join_outer_align": "with n as (select o_custkey, count(*) filter (year(o_orderdate) = 1997) as target, count(*) filter (year(o_orderdate) = 1996) as held from orders group by 1) select o_custkey, target, held, target - held as change from n where target <> held",
    "join_densify": f"with {MONTHS}, g as (select * from (select distinct entity from months) cross join (select distinct month from months)) select entity, round(quantile_cont(coalesce(value, 0), 0.5), 6) + 0.0 as median, count(value) as valid from g left join months using (entity, month) group by entity",
    "join_frame_diff": f"with {BARS}, y as (select symbol, ts, open, greatest(close, open) as close from bars where volume > 1), p as (select b.open as o1, y.open as o2, b.close as c1, y.close as c2 from bars b join y using (symbol, ts)) select 'open' as field, count(*) as overlap, count(*) filter (o1 is distinct from o2) as mismatches from p union all select 'close', count(*), count(*) filter (c1 is distinct from c2) from p",
    "join_cross_check": f"with {HOURS}, h as (select symbol, session, max(high) as h, min(low) as l, sum(volume) as v from hours group by 1, 2), o as (select event_type as symbol, ts::date as session, max(value) as oh, min(value) as ol, count(*) as ov from events where value > 1 group by 1, 2) select symbol, session, case when h is null or oh is null then 'C1' when h > oh * 1.0001 or l < ol * 0.9999 then 'C2' when not (ov / v between 0.5 and 1.05) then 'C3' else 'OK' end as flag from h full join o using (symbol, session)",
    "agg_group": "select o_custkey, min(o_orderdate::date) as first, max(o_orderdate::date) as last, count(*) as n, count(distinct o_orderpriority) as n_priorities from orders group by 1",
    "agg_product": "select l_orderkey, round(product(1 - l_discount), 6) + 0.0 as factor, string_agg(distinct l_returnflag, '+' order by l_returnflag) as flags from lineitem group by 1",
    "agg_conditional": f"with {BARS} select symbol, count(*) as rows, count(*) filter (high < greatest(open, close) or low > least(open, close)) as impossible, count(*) filter (volume = 1) as thin, count(*) filter (isodow(ts) >= 6) as weekend from bars group by 1",
    "agg_bool": "select o_custkey, bool_and(o_orderstatus = 'F')::int as all_finished, bool_or(o_orderstatus = 'O')::int as any_open from orders group by 1",
    "agg_value_counts": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2",
    "agg_sets": "with t as (select user_id, event_type, bool_or(day(ts) <= 15) as a, bool_or(day(ts) > 15) as b from events group by 1, 2) select user_id, coalesce(string_agg(event_type, ',' order by event_type) filter (a and not b), '') as lost, coalesce(string_agg(event_type, ',' order by event_type) filter (a and b), '') as kept from t group by 1",
    "agg_quantiles": "select o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 6) + 0.0 as q{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9)) + " from orders group by 1",
    "agg_ohlc": f"with {HOURS} select * from hours",
    "agg_pivot": "select year(o_orderdate)::int as y, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1",
    "agg_skew": f"with {MONTHS} select entity, round(skewness(value), 6) + 0.0 as skew, arg_min(month, value) as worst from months group by 1",
    "agg_calendar": "with d as (select unnest(generate_series(date '1996-01-01', date '1996-12-31', interval 1 day))::date as day) select strftime(day, '%Y-%m') as month, count(*) as missing from d where isodow(day) < 6 and day not in (select o_orderdate::date from orders where o_orderpriority = '1-URGENT') group by 1",
    "top_tie_break": f"with {MONTHS}, r as (select month, entity, row_number() over (partition by month order by value desc, entity)::int as place from months) select month, place, entity from r where place <= 3",
    "top_proportional": f"with {MONTHS}, r as (select month, entity, row_number() over (partition by month order by value desc, entity) as i, count(*) over (partition by month) as n from months), k as (select *, floor(n * 0.3 + 0.5) as k from r) select month, entity, case when i <= k then 'W' else 'L' end as leg from k where i <= k or i > n - k",
    "top_tail": f"with {BARS} select symbol, ts, close from bars qualify row_number() over (partition by symbol order by ts desc) <= 20",
    "split_chronological": f"with {BARS}, r as (select symbol, ts, row_number() over (partition by symbol order by ts) as i, count(*) over (partition by symbol) as n from bars), p as (select symbol, ts, case when i <= round_even(n * 0.5, 0) then 'train' when i <= round_even(n * 0.75, 0) then 'validate' else 'test' end as part from r) select symbol, part, count(*) as n, min(ts) as first, max(ts) as last from p group by 1, 2",
    "set_upsert": "select o_custkey, o_orderdate::date as day, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2",
    "set_operations": f"with {BARS}, a as (select ts from bars where symbol = '1-URGENT'), b as (select ts from bars where symbol = '5-LOW') select ts, case when x and y then 'both' when x then 'first' else 'second' end as kind from (select coalesce(a.ts, b.ts) as ts, a.ts is not null as x, b.ts is not null as y from a full join b on a.ts = b.ts)",
    "project_downsample": f"with {BARS}, r as (select symbol, ts, close, row_number() over (partition by symbol order by ts) - 1 as i, greatest(1, count(*) over (partition by symbol) // 300) as k from bars) select symbol, ts, close from r where i % k = 0",
    "project_classify": "select case when isodow(o_orderdate) >= 6 then 'WEEKEND' when o_totalprice > 200000 then 'TOP' when o_totalprice < 20000 then 'LOW' else 'MID' end as band, count(*) as n from orders group by 1",
    "filter_exclusions": f"with {BARS} select symbol, count(*) as n, max(ts) as last from bars where ts < date '2000-01-01' and not (symbol = '1-URGENT' and ts between date '1996-01-01' and date '1996-03-31') and not (symbol = '5-LOW' and ts between date '1997-06-01' and date '1997-06-30') group by 1",
    "service_watchlist": f"with {BARS}, r as (select *, row_number() over (partition by symbol order by ts desc) as i from bars) select symbol, max(ts) as ts, max(close) filter (i = 1) as last, round((max(close) filter (i = 1) / max(close) filter (i = 2) - 1) * 100, 6) + 0.0 as change_pct, (date '2001-08-15' - max(ts) > 30)::int as stale from r where i <= 2 group by symbol having count(*) = 2",
    "json_nested": "select event_type, sum((props->>'$.k')::bigint)::bigint as k_sum, count(props) as n from events group by 1",
}
