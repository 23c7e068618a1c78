"""A ladder of monthly portfolios under several treatments of the same data.

Everything is long: a study panel with one row per entity and session, a calendar with one row per
month, members with one row per step, month, leg and entity. Steps that differ only in universe,
return rule or treatment run side by side as rows of one plan. A session belongs to exactly one
holding period, so holdings meet the panel by equality; bookings of gaps are found by running
minima. Windows run over a calendar (bounded by its days) or over the sessions of one entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """universe: key of the universe; rule: NAIVE or RG; delists: whether exits are booked."""

    name: str
    universe: str
    rule: str
    delists: bool = False


#: The four steps: a fixed universe, one per month of today's pool, one of all, and graded returns.
STEPS = (Step("A", "A", "NAIVE"), Step("B", "B", "NAIVE"), Step("C", "C", "NAIVE", True), Step("D", "C", "RG", True))


def calendar(days: DataFrame, *, long_ago: int = 12, skip: int = 1, primary_until=None) -> DataFrame:
    """(t, m12, m1, s_plus, s_pp, holding_month, sample): one row per month of the sessions (date).

    t, m12 and m1 are the last sessions of the month, of long_ago and of skip months before it;
    s_plus is the first session after t, s_pp the first after the next month's last one. Null
    where the sessions don't reach or a month holds none.
    """
    months = days.groupBy(F.trunc("date", "MM").alias("m")).agg(F.max("date").alias("t"), F.min("date").alias("first"))
    after = F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("m"))
    months = months.select("m", "t", after.alias("s_plus"))
    at = lambda k, name: months.select(F.add_months("m", k).alias("m"), F.col("t").alias(name))
    exits = months.select(F.add_months("m", -1).alias("m"), F.col("s_plus").alias("s_pp"))
    x = months.join(at(long_ago, "m12"), "m", "left").join(at(skip, "m1"), "m", "left").join(exits, "m", "left")
    sample = F.lit("PRIMARY") if primary_until is None else F.when(F.col("t") <= F.lit(primary_until), "PRIMARY").otherwise("OOS")
    return x.select("t", "m12", "m1", "s_plus", "s_pp", F.date_format(F.add_months("m", 1), "yyyy-MM").alias("holding_month"), sample.alias("sample"))


def universes(ranked: DataFrame, pool: Column, *, size: int, fixed_on) -> DataFrame:
    """(universe, t, entity): the best entities of each month by place, then entity.

    ranked: t, entity, place of admissible entities, one row each. C takes all entities, B those
    of the pool, A those of the pool on the day fixed_on, whatever the month.
    """
    order = Window.partitionBy("universe", "t").orderBy("place", "entity")
    keyed = ranked.select(F.explode(F.array(F.lit("C"), F.when(F.coalesce(pool, F.lit(False)), F.lit("B")))).alias("universe"), "t", "entity", "place").where("universe is not null")
    best = keyed.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= size).select("universe", "t", "entity")
    fixed = best.where((F.col("universe") == "B") & (F.col("t") == fixed_on)).select("entity")
    months = ranked.select(F.collect_set("t")).scalar()  # no more than months
    return best.unionByName(fixed.select(F.lit("A").alias("universe"), F.explode(months).alias("t"), "entity"))


def study_panel(rows: DataFrame) -> DataFrame:
    """(entity, date, r_naive, r_rg, r_raw, cls, raw_ok, gap_free) from graded return rows.

    rows: entity, date, close, prev_close, ret_raw, event_factor, ret_adj, return_status. r_naive
    applies any factor, whatever its status; r_rg is the graded return; cls is SPAN, OK, FIRST or
    BAD, the first that fits; raw_ok says that the raw return of a row stands without event or
    jump; gap_free marks rows after a gap of several sessions without an event.
    """
    status, factor = F.col("return_status"), F.col("event_factor")
    cls = F.when(status == "SPECIAL_SESSION_SPAN", "SPAN").when(status.isin("OK", "ADJUSTED_VALIDATED"), "OK").when(status == "FIRST_OBSERVATION", "FIRST").otherwise("BAD")
    naive = F.when(factor.isNotNull(), F.try_divide("close", F.col("prev_close") * factor) - 1).otherwise(F.col("ret_raw"))
    within = F.when(F.col("ret_raw") > -1, F.abs(F.log1p("ret_raw")) <= F.log(F.lit(1.4)))
    return rows.select(
        "entity", "date", naive.alias("r_naive"), F.when(cls == "OK", F.coalesce("ret_adj", "ret_raw")).alias("r_rg"), F.col("ret_raw").alias("r_raw"), cls.alias("cls"),
        (factor.isNull() & F.coalesce(within, F.lit(False))).alias("raw_ok"), ((status == "MULTI_SESSION_GAP") & factor.isNull()).alias("gap_free"),
    )


def treated(panel: DataFrame, *, span_raw: bool = False, gap_raw: bool = False) -> DataFrame:
    """The panel with spans of special sessions, or gaps without an event, taken at their raw return."""
    use = (F.lit(span_raw) & (F.col("cls") == "SPAN")) | (F.lit(gap_raw) & F.col("gap_free"))
    return panel.withColumn("r_rg", F.when(use, F.col("r_raw")).otherwise(F.col("r_rg"))).withColumn("cls", F.when(use, "OK").otherwise(F.col("cls")))


def formations(members: DataFrame, panel: DataFrame, months: DataFrame, *, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """(step, t, entity, score) of rankable members: growth over (m12, m1] by prefix sums of logs.

    members: universe, t, entity. An entity is rankable with a row exactly on m12 and on m1, under
    RG also without a BAD or FIRST row after m12 up to m1.
    """
    upto = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    plain = F.when(F.col("cls") == "FIRST", 0.0).otherwise(F.coalesce(F.log1p("r_naive"), F.lit(0.0)))
    graded = F.when(F.col("cls") == "OK", F.coalesce(F.log1p("r_rg"), F.lit(0.0))).otherwise(0.0)
    sums = panel.select("entity", "date", F.sum(plain).over(upto).alias("n"), F.sum(graded).over(upto).alias("g"), F.sum(F.col("cls").isin("BAD", "FIRST").cast("int")).over(upto).alias("bad"))
    at = lambda day, p: sums.select("entity", F.col("date").alias(day), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "g", "bad")])
    named = members.withColumn("step", F.explode(_by_universe(steps, lambda s: F.lit(s.name))))
    both = named.join(months.select("t", "m12", "m1"), "t").join(at("m12", "a"), ["entity", "m12"]).join(at("m1", "b"), ["entity", "m1"])
    graded_step = F.col("step").isin([s.name for s in steps if s.rule == "RG"])
    score = F.when(graded_step, F.expm1(F.col("b_g") - F.col("a_g"))).otherwise(F.expm1(F.col("b_n") - F.col("a_n")))
    return both.where(~graded_step | (F.col("a_bad") == F.col("b_bad"))).select("step", "t", "entity", score.alias("score"))


def _by_universe(steps: tuple[Step, ...], of) -> Column:
    """An array of of(step) for the steps that use the row's universe."""
    out = F.lit(None)
    for key in {s.universe for s in steps}:
        out = F.when(F.col("universe") == key, F.array(*[of(s) for s in steps if s.universe == key])).otherwise(out)
    return out


def legs(scores: DataFrame, *, share: float = 0.3, by: tuple[str, ...] = ("step", "t"), market: bool = True) -> DataFrame:
    """(*by, entity, leg): W the first k by score, L the last k, k = floor(share n + 0.5), ties by entity; BM everyone."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "entity")
    x = scores.select(*by, "entity", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"))
    x = x.withColumn("k", F.floor(F.col("n") * share + 0.5))
    leg = F.array(F.when(F.col("i") <= F.col("k"), "W"), F.when(F.col("i") > F.col("n") - F.col("k"), "L"), *([F.lit("BM")] if market else []))
    return x.select(*by, "entity", F.explode(F.filter(leg, lambda c: c.isNotNull())).alias("leg"))


def _periods(days: DataFrame, months: DataFrame) -> DataFrame:
    """(date, t): the month whose holding period (s_plus, s_pp] a session lies in."""
    marks = months.where("s_plus is not null and s_pp is not null").select(F.col("s_plus").alias("date"), F.struct("s_plus", "t", "s_pp").alias("_mark"))
    order = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    x = days.select("date").distinct().join(marks, "date", "left").withColumn("_in", F.last("_mark", ignorenulls=True).over(order))
    return x.where("date <= _in.s_pp").select("date", F.col("_in.t").alias("t"))


def gap_bookings(members: DataFrame, panel: DataFrame, months: DataFrame) -> DataFrame:
    """members (step, t, leg, entity) without a row at s_pp, with the first later row booked for them.

    (step, t, leg, entity, booked, r_naive, r_raw, raw_ok); the last four are null for members that
    never come back. A booking depends only on the members and the rows present, not on bookings
    of earlier months; a row may be booked from several months.
    """
    held = members.join(months.where("s_plus is not null and s_pp is not null").select("t", "s_pp"), "t")
    gone = held.join(panel.select("entity", F.col("date").alias("s_pp")).distinct(), ["entity", "s_pp"], "left_anti")
    marks = panel.select("entity", "date", F.struct("date", "r_naive", "r_raw", "raw_ok").alias("_mark"))
    asks = gone.select("entity", F.col("s_pp").alias("date"), "step", "t", "leg")
    w = Window.partitionBy("entity").orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    x = asks.unionByName(marks, allowMissingColumns=True).withColumn("_next", F.min("_mark").over(w))
    return x.where("t is not null").select("step", "t", "leg", "entity", F.col("_next.date").alias("booked"), F.col("_next.r_naive").alias("r_naive"), F.col("_next.r_raw").alias("r_raw"), F.col("_next.raw_ok").alias("raw_ok"))


def holdings(members: DataFrame, panel: DataFrame, months: DataFrame, *, steps: tuple[Step, ...] = STEPS, delisted: float = -0.3, missing: str = "FILL") -> DataFrame:
    """(step, t, leg, entity, value, filled, alone, spans, booked, gone): worth at s_pp of one unit bought at s_plus.

    NAIVE multiplies r_naive of the rows in (s_plus, s_pp]. RG multiplies r_rg of OK rows; a BAD or
    FIRST row gets by FILL the mean r_rg of the OK rows of the same step, month, leg and day (0 if
    there is none: alone), by RAW its own raw return, by ZERO nothing; SPAN rows count for nothing.
    In a step that delists, a member without a row at s_pp also gets the return of its first later
    row (raw under RG, naive otherwise), or delisted if it never comes back; a row booked so counts
    in no later month of the same step and leg, neither for the member nor in the mean. Members
    without any row keep their value. Months without s_plus or s_pp are left out.
    """
    if missing not in ("FILL", "RAW", "ZERO"):
        raise ValueError(f"unknown treatment {missing!r}")
    whole = months.where("s_plus is not null and s_pp is not null").select("t")
    held = members.join(whole, "t", "left_semi")
    delists, graded = F.col("step").isin([s.name for s in steps if s.delists]), F.col("step").isin([s.name for s in steps if s.rule == "RG"])
    gaps = gap_bookings(members.where(delists), panel, months)
    used = gaps.where("booked is not null").groupBy("step", "leg", "entity", F.col("booked").alias("date")).agg(F.min("t").alias("_t"))
    x = held.join(panel.join(_periods(panel, months), "date"), ["entity", "t"])
    x = x.join(used, ["step", "leg", "entity", "date"], "left").withColumn("_used", F.coalesce(F.col("_t") < F.col("t"), F.lit(False)))
    ok = (F.col("cls") == "OK") & ~F.col("_used")
    bad = F.col("cls").isin("BAD", "FIRST") & ~F.col("_used") & graded
    mean = F.avg(F.when(ok, F.col("r_rg"))).over(Window.partitionBy("step", "t", "leg", "date"))
    instead = {"FILL": F.coalesce(F.col("_mean"), F.lit(0.0)), "RAW": F.coalesce("r_raw", F.lit(0.0)), "ZERO": F.lit(0.0)}[missing]
    rg = F.when(ok, F.col("r_rg")).when(bad, instead).otherwise(0.0)
    naive = F.when(F.col("_used") | (F.col("cls") == "FIRST"), 0.0).otherwise(F.coalesce("r_naive", F.lit(0.0)))
    x = x.withColumn("_mean", mean).withColumn("_r", F.when(graded, rg).otherwise(naive))
    days = x.groupBy("step", "t", "leg", "entity").agg(
        F.product(1 + F.col("_r")).alias("_value"),
        F.count_if(bad).alias("filled"),
        F.count_if(bad & F.col("_mean").isNull()).alias("alone"),
        F.count_if((F.col("cls") == "SPAN") & graded).alias("spans"),
    )
    back = F.when(graded, F.col("r_raw")).otherwise(F.col("r_naive"))
    ends = gaps.select("step", "t", "leg", "entity", (1 + F.when(F.col("booked").isNull(), F.lit(delisted)).otherwise(F.coalesce(back, F.lit(0.0)))).alias("_end"), "booked", F.col("booked").isNull().alias("gone"))
    keys = ["step", "t", "leg", "entity"]
    each = held.select(*keys).join(days, keys, "left").join(ends, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    value = F.coalesce("_value", F.lit(1.0)) * F.coalesce("_end", F.lit(1.0))
    return each.select(*keys, value.alias("value"), zero("filled"), zero("alone"), zero("spans"), "booked", F.coalesce("gone", F.lit(False)).alias("gone"))


def monthly(held: DataFrame, members: DataFrame, scores: DataFrame, universe: DataFrame, months: DataFrame, *, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """(t, holding_month, sample, step, status, n_universe, n_rankable, k, W, L, BM, WML): every month of every step.

    A month that can't be computed stays, with its reason: NO_FORMATION_DATA, NO_RANKABLE_STOCKS or
    NO_HOLDING_DATA.
    """
    sizes = universe.withColumn("step", F.explode(_by_universe(steps, lambda s: F.lit(s.name)))).groupBy("step", "t").agg(F.count(F.lit(1)).alias("n_universe"))
    n = scores.groupBy("step", "t").agg(F.count(F.lit(1)).alias("n_rankable"))
    k = members.where("leg = 'W'").groupBy("step", "t").agg(F.count(F.lit(1)).alias("k"))
    means = held.groupBy("step", "t").pivot("leg", ["W", "L", "BM"]).agg(F.avg("value") - 1)
    x = sizes.join(months, "t").join(n, ["step", "t"], "left").join(k, ["step", "t"], "left").join(means, ["step", "t"], "left")
    x = x.fillna(0, ["n_rankable", "k"])
    status = (
        F.when(F.col("m12").isNull() | F.col("m1").isNull(), "NO_FORMATION_DATA")
        .when(F.col("k") == 0, "NO_RANKABLE_STOCKS")
        .when(F.col("s_plus").isNull() | F.col("s_pp").isNull(), "NO_HOLDING_DATA")
        .otherwise("OK")
    )
    x = x.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "OK", c)
    return x.select("t", "holding_month", "sample", "step", "status", "n_universe", "n_rankable", "k", *[ok(F.col(c)).alias(c) for c in ("W", "L", "BM")], ok(F.col("W") - F.col("L")).alias("WML"))


def paired_delta(results: DataFrame, *, first: str = "A", last: str = "D") -> DataFrame:
    """(t, holding_month, sample, delta, paired, reason): WML of the first step less the last in per cent, where both are OK."""
    x = results.groupBy("t", "holding_month", "sample").agg(
        *[F.coalesce(F.max(F.when(F.col("step") == s, F.col("status"))), F.lit("NOT_RUN")).alias(f"s{i}") for i, s in enumerate((first, last))],
        *[F.max(F.when(F.col("step") == s, F.col("WML"))).alias(f"w{i}") for i, s in enumerate((first, last))],
    )
    both = (F.col("s0") == "OK") & (F.col("s1") == "OK")
    reason = F.when(both, "").otherwise(F.concat(F.lit(f"{first}:"), "s0", F.lit(f" {last}:"), "s1"))
    return x.select("t", "holding_month", "sample", F.when(both, (F.col("w0") - F.col("w1")) * 100).alias("delta"), both.alias("paired"), reason.alias("reason"))


def weights(held: DataFrame) -> DataFrame:
    """held with begin_weight (equal) and end_weight (by value) within its step, month and leg."""
    w = Window.partitionBy("step", "t", "leg")
    return held.withColumn("begin_weight", 1.0 / F.count(F.lit(1)).over(w)).withColumn("end_weight", F.try_divide("value", F.sum("value").over(w)))


def rebalances(held: DataFrame, months: DataFrame) -> DataFrame:
    """(step, t, leg, entity, drift_weight, target_weight, weight_change): the orders of each month, none for a change of zero.

    held: weights(). A month drifts from the one before it; after a gap, and in the first month,
    everything is bought.
    """
    following = months.select(F.add_months(F.trunc("t", "MM"), 1).alias("_m"), F.col("t").alias("_t")).join(months.select(F.trunc("t", "MM").alias("_m"), F.col("t").alias("next_t")), "_m").drop("_m")
    target = held.select("step", "t", "leg", "entity", F.col("begin_weight").alias("target_weight"))
    drift = held.join(following, held.t == following["_t"]).select("step", F.col("next_t").alias("t"), "leg", "entity", F.col("end_weight").alias("drift_weight"))
    runs = held.select("step", "t", "leg").distinct()
    both = target.join(drift, ["step", "t", "leg", "entity"], "full_outer").fillna(0.0, ["target_weight", "drift_weight"]).join(runs, ["step", "t", "leg"], "left_semi")
    return both.withColumn("weight_change", F.col("target_weight") - F.col("drift_weight")).where("weight_change != 0").select("step", "t", "leg", "entity", "drift_weight", "target_weight", "weight_change")
