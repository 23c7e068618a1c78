"""Queries of the general training-data problems (1, 2, 3, 6, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.history import identifier_history
from marketloom.operators.orphans import periodic_counts, replay, snapshot, snapshot_counts
from marketloom.operators.pit import attributes_as_known, periods_in_force
from marketloom.operators.spikes import implausible_readings
from marketloom.operators.timestamps import instants
from marketloom.session import clean_key, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, attribute, row_id): universe row and cost rates known at each order's s_plus."""
    orders = table(spark, sf_dir, "step_e").select("order_id", "entity", "s_plus")
    rank = attributes_as_known(
        orders,
        table(spark, sf_dir, "univ1_pit_universe"),
        event_id="order_id",
        event_entity="entity",
        event_day="s_plus",
        entity="entity_id",
        valid_from="selection_date",
        known_from="recorded_on",
        row_id="univ_id",
    )
    rates = periods_in_force(
        orders,
        table(spark, sf_dir, "delivery_nse_eq_s2mom_v1_dated"),
        event_id="order_id",
        event_day="s_plus",
        component="component",
        start="from",
        end="to",
        known_from="known_on",
        row_id="rate_id",
    )
    return rank.select("order_id", F.lit("rank").alias("attribute"), F.col("univ_id").alias("row_id")).unionByName(
        rates.select("order_id", F.col("component").alias("attribute"), F.col("rate_id").alias("row_id"))
    )


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"

P1_SQL = f"""
with o as (select distinct order_id, {_TRIM.format('entity')} as entity, s_plus from step_e where s_plus is not null),
r as (
  select o.order_id, u.univ_id,
    row_number() over (partition by o.order_id, o.s_plus, o.entity order by u.selection_date desc, u.recorded_on desc, u.univ_id desc) as n
  from o join (select distinct univ_id, entity_id, selection_date, recorded_on from univ1_pit_universe) u
    on u.entity_id = o.entity and u.selection_date <= o.s_plus and u.recorded_on <= o.s_plus),
c as (
  select o.order_id, d.component, d.rate_id,
    row_number() over (partition by o.order_id, o.s_plus, o.entity, d.component order by d.known_on desc, d.rate_id desc) as n
  from o join (select distinct rate_id, component, "from" as f, "to" as t, known_on from delivery_nse_eq_s2mom_v1_dated) d
    on d.f <= o.s_plus and (d.t is null or o.s_plus <= d.t) and d.known_on <= o.s_plus)
select order_id, 'rank' as attribute, univ_id as row_id from r where n = 1
union all
select order_id, component as attribute, rate_id as row_id from c where n = 1
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(residual_id): readings that are not believable for their entity."""
    return implausible_readings(table(spark, sf_dir, "ret1_1_large_residuals"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attribute, entity_id, value, valid_from, valid_to), all strings."""
    history = identifier_history(
        table(spark, sf_dir, "id1_later_symbol_ca_resolution"), table(spark, sf_dir, "id1_flags"), table(spark, sf_dir, "id1_segments")
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return history.select("attribute", "entity_id", "value", day("valid_from"), day("valid_to"))


P3_SQL = r"""
with s as (
  select distinct res_id, upper(trim(symbol, ' ' || chr(9) || chr(10) || chr(13))) as symbol,
    upper(trim(historical_symbol, ' ' || chr(9) || chr(10) || chr(13))) as historical, trim(entity_id) as entity_id, ex_date, recorded_on
  from id1_later_symbol_ca_resolution where entity_id is not null),
sr as (
  select entity_id, historical as value, ex_date as day, recorded_on, res_id, 0 as role from s where historical <> '' and ex_date is not null
  union all
  select entity_id, symbol as value, recorded_on as day, recorded_on, res_id, 1 as role from s where symbol <> '' and recorded_on is not null),
sb as (select *, row_number() over (partition by entity_id, day order by recorded_on desc, res_id desc, role desc) as n from sr),
sl as (select *, lag(value) over (partition by entity_id order by day) as before from sb where n = 1),
sv as (select *, lead(day) over (partition by entity_id order by day) as until from sl where before is null or before <> value),
f as (
  select distinct flag_id, trim(segment_id, ' ' || chr(9) || chr(10) || chr(13)) as segment_id, detail, flagged_on,
    regexp_matches(detail, '(?i)replaces') as swapped,
    regexp_extract(case when regexp_matches(detail, '!=|<>') then regexp_extract(detail, '[^ ]+ ?(!=|<>) ?[^ ]+') else detail end, '(?i)\b([A-Z]{2}[A-Z0-9]{9}[0-9])\s*(?:!=|<>|->|=>|→|to|replaces)\s*([A-Z]{2}[A-Z0-9]{9}[0-9])\b', 1) as a,
    regexp_extract(case when regexp_matches(detail, '!=|<>') then regexp_extract(detail, '[^ ]+ ?(!=|<>) ?[^ ]+') else detail end, '(?i)\b([A-Z]{2}[A-Z0-9]{9}[0-9])\s*(?:!=|<>|->|=>|→|to|replaces)\s*([A-Z]{2}[A-Z0-9]{9}[0-9])\b', 2) as b,
    coalesce(
      try_strptime(regexp_extract(detail, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '%Y-%m-%d'),
      try_strptime(regexp_extract(detail, '[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}'), '%d-%b-%Y'),
      try_strptime(regexp_extract(detail, '[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}'), '%d %B %Y'),
      try_strptime(regexp_extract(detail, '\b(20[0-9]{6})\b', 1), '%Y%m%d'))::date as day
  from id1_flags),
c as (
  select g.entity_id, upper(case when f.swapped then f.b else f.a end) as old, upper(case when f.swapped then f.a else f.b end) as new, f.day, f.flagged_on, f.flag_id
  from f join id1_segments g on trim(g.segment_id) = f.segment_id where f.a <> '' and f.day is not null),
cb as (select *, row_number() over (partition by entity_id, old, new order by flagged_on desc, flag_id desc) as n from c where old <> new),
cr as (select *, row_number() over (partition by entity_id order by day, flagged_on, flag_id) as place from cb where n = 1),
ir as (
  select entity_id, old as value, date '0001-01-01' as day, flagged_on, flag_id from cr where place = 1
  union all
  select entity_id, new as value, day, flagged_on, flag_id from cr),
ib as (select *, row_number() over (partition by entity_id, day order by flagged_on desc, flag_id desc) as n from ir),
il as (select *, lag(value) over (partition by entity_id order by day) as before from ib where n = 1),
iv as (select *, lead(day) over (partition by entity_id order by day) as until from il where before is null or before <> value)
select 'symbol' as attribute, entity_id, value, strftime(day, '%Y-%m-%d') as valid_from, coalesce(strftime(until, '%Y-%m-%d'), '9999-12-31') as valid_to from sv
union all
select 'isin' as attribute, entity_id, value, case when day = date '0001-01-01' then '0001-01-01' else strftime(day, '%Y-%m-%d') end as valid_from,
  coalesce(strftime(until, '%Y-%m-%d'), '9999-12-31') as valid_to from iv
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, rec_id, utc_micros) of every readable date and session."""
    feeds = table(spark, sf_dir, "feeds")
    records = instants(table(spark, sf_dir, "identity_raw"), feeds, row_id="rec_id", text="date", feed="feed")
    sessions = instants(table(spark, sf_dir, "portfolio_daily_primary"), feeds, row_id="pd_id", text="session", feed="feed")
    return records.select(F.lit("identity_raw").alias("source_table"), "rec_id", "utc_micros").unionByName(
        sessions.select(F.lit("portfolio_daily_primary").alias("source_table"), F.col("pd_id").alias("rec_id"), "utc_micros")
    )


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def refs(name: str, space: str, key: str, day: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(space).alias("space"), clean_key(key).alias("ref_key"), F.lit(name).alias("ref_table"), F.col(day).alias("day"))

    segments = table(spark, sf_dir, "id1_segments")
    parents = [
        segments.select(F.lit(space).alias("space"), F.col("segment_id").alias("parent_id"), clean_key(key).alias("ref_key"), "registered_on", "removed_on")
        for space, key in (("segment", "segment_id"), ("entity", "entity_id"))
    ]
    references = (
        refs("step_e", "entity", "entity", "s_plus")
        .unionByName(refs("univ1_pit_universe", "segment", "segment_at_selection", "selection_date"))
        .unionByName(refs("id1_flags", "segment", "segment_id", "flagged_on"))
    )
    return references, parents[0].unionByName(parents[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_table, period, ref_key, cause): references that id1_segments does not support."""
    return snapshot(replay(*_references(spark, sf_dir)))


def p7_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_table, period, cause, n_keys): orphan keys per table, month and cause."""
    return snapshot_counts(replay(*_references(spark, sf_dir)))


def p7_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(as_of, ref_table, period, cause, n_keys): the same counts as they stood at the end of each of four spans of days."""
    counts = periodic_counts(*_references(spark, sf_dir), increments=4)
    return counts.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


_P7_REFS = f"""
with refs as (
  select distinct 'step_e' as ref_table, 'e' as space, {_TRIM.format('entity')} as ref_key, s_plus as day from step_e
  union select distinct 'univ1_pit_universe', 's', {_TRIM.format('segment_at_selection')}, selection_date from univ1_pit_universe
  union select distinct 'id1_flags', 's', {_TRIM.format('segment_id')}, flagged_on from id1_flags),
par as (
  select 's' as space, segment_id as ref_key, registered_on, removed_on from id1_segments
  union all select 'e', entity_id, registered_on, removed_on from id1_segments)"""
_P7_FOUND = f"""{_P7_REFS},
seen as (
  select r.ref_table, r.ref_key, r.day,
    count(p.ref_key) as parents,
    count(*) filter (p.registered_on <= r.day) as registered,
    count(*) filter (p.registered_on <= r.day and (p.removed_on is null or p.removed_on > r.day)) as sound
  from refs r left join par p on p.space = r.space and p.ref_key = r.ref_key
  where r.ref_key <> '' and r.day is not null group by all),
found as (
  select distinct ref_table, strftime(day, '%Y-%m') as period, ref_key,
    case when parents = 0 then 'MISSING' when registered = 0 then 'LATE' else 'DELETED' end as cause
  from seen where sound = 0)
"""
P7_SQL = _P7_FOUND + "select ref_table, period, ref_key, cause from found"
P7_COUNTS_SQL = _P7_FOUND + "select ref_table, period, cause, count(*) as n_keys from found group by all"

P7_SNAPSHOTS_SQL = f"""{_P7_REFS},
span as (select min(day) as lo, max(day) as hi from refs where ref_key <> '' and day is not null),
cuts as (select i, case when i = 4 then hi else lo + floor((hi - lo) * i / 4.0)::int end as cut from span, range(1, 5) t(i)),
seen as (
  select c.cut, r.ref_table, r.ref_key, r.day,
    count(*) filter (p.registered_on <= c.cut or (c.i = 4 and p.ref_key is not null)) as parents,
    count(*) filter (p.registered_on <= r.day) as registered,
    count(*) filter (p.registered_on <= r.day and (p.removed_on is null or p.removed_on > r.day)) as sound
  from refs r join cuts c on r.day <= c.cut left join par p on p.space = r.space and p.ref_key = r.ref_key
  where r.ref_key <> '' group by all),
found as (
  select distinct cut, ref_table, strftime(day, '%Y-%m') as period, ref_key,
    case when parents = 0 then 'MISSING' when registered = 0 then 'LATE' else 'DELETED' end as cause
  from seen where sound = 0)
select strftime(cut, '%Y-%m-%d') as as_of, ref_table, period, cause, count(*) as n_keys from found group by all
"""

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p6_found, p7_found, p7_orphan_counts, p7_snapshots)}
SQL = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p7_found": P7_SQL, "p7_orphan_counts": P7_COUNTS_SQL, "p7_snapshots": P7_SNAPSHOTS_SQL}
