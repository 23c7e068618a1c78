"""As-of, interval and alignment joins.

Every range join carries an equality key, so that it hashes on the key with the range as a
residual filter; a keyless range is first turned into one by a calendar bucket. As-of lookups
that would pair many rows of a key are running aggregates over a union instead of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(events: DataFrame, rows: DataFrame, key: str, event_day: str, row_day: str) -> DataFrame:
    """events with the first row of their key dated on or after them, if no earlier row lies between.

    Union and running minimum from the future: one pass over the key's days, no pairs. Events
    without a later row are left out; repeated row days count once.
    """
    marks = rows.select(key, F.col(row_day).alias("_day")).distinct().withColumn("_row", F.col("_day"))
    asks = events.select("*", F.col(event_day).alias("_day")).withColumn("_ask", F.lit(1))
    w = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = asks.unionByName(marks, allowMissingColumns=True)
    return both.withColumn("matched_day", F.min("_row").over(w)).where("_ask = 1 and matched_day is not null").drop("_day", "_row", "_ask")


def interval_lookup(facts: DataFrame, periods: DataFrame, key: str, day: str, start: str, end: str, value: str) -> DataFrame:
    """facts with the value of the one period in force; raises if none or several are.

    For period tables: the periods of a key travel as one array, so a fact meets one row and is
    looked at once, without an exchange of the facts as long as Spark can broadcast the periods.
    """
    p = periods.where(F.col(start).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(value).alias("v"))).alias("_periods"))
    hit = facts.join(p, key, "left")
    in_force = F.filter("_periods", lambda r: (r["s"] <= F.col(day)) & (r["e"].isNull() | (F.col(day) <= r["e"])))
    checked = F.when(F.coalesce(F.size(in_force), F.lit(0)) == 1, F.get(in_force, F.lit(0))["v"]).otherwise(F.raise_error(F.lit("not exactly one period in force")).cast("double"))
    return hit.withColumn(value, checked).drop("_periods")


def near_in_time(asks: DataFrame, marks: DataFrame, key: str, day: str, mark_day: str, days: int, name: str) -> DataFrame:
    """asks with a boolean: whether a mark of the key lies within so many days, before or after.

    The nearest mark on either side decides, found by one range window over the key's rows; no
    ask is paired with a mark. Asks without key or day have none near.
    """
    at = lambda c: F.datediff(c, F.to_date(F.lit("1970-01-01")))
    m = marks.select(key, F.col(mark_day).alias(day)).distinct().withColumn("_mark", F.lit(1))
    w = Window.partitionBy(key).orderBy(at(day)).rangeBetween(-days, days)
    x = asks.withColumn("_ask", F.lit(1)).unionByName(m, allowMissingColumns=True)
    near = F.coalesce(F.max("_mark").over(w) == 1, F.lit(False)) & F.col(key).isNotNull() & F.col(day).isNotNull()
    return x.withColumn(name, near).where("_ask = 1").drop("_ask", "_mark")


def align_outer(target: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer alignment, missing = 0; rows whose difference is zero are left out."""
    t, c = target.select(*keys, F.col(value).alias("target")), current.select(*keys, F.col(value).alias("held"))
    both = t.join(c, keys, "full_outer").fillna(0, ["target", "held"])
    return both.withColumn("change", F.col("target") - F.col("held")).where("change != 0")


def frame_difference(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, overlap, mismatches): rows of equal keys compared field by field; null equals null."""
    pair = left.select(*keys, *[F.col(f).alias(f"_l_{f}") for f in fields]).join(right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields]), keys)
    agg = pair.agg(F.count(F.lit(1)).alias("overlap"), *[F.count_if(~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}"))).alias(f) for f in fields])
    return agg.select("overlap", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mismatches")) for f in fields])).alias("x")).select("x.field", "overlap", "x.mismatches")


def require_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises on an unmatched or repeated key of either side."""
    w = Window.partitionBy(*keys)
    n_l, n_r = left.withColumn("_nl", F.count(F.lit(1)).over(w)), right.withColumn("_nr", F.count(F.lit(1)).over(w))
    both = n_l.join(n_r, keys, "full_outer")
    good = F.coalesce((F.col("_nl") == 1) & (F.col("_nr") == 1), F.lit(False))
    return both.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("join is not one to one")).cast("boolean"))).drop("_nl", "_nr")
