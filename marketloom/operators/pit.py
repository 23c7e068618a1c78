"""Attributes as they were known at event time.

An event may only meet attribute rows that were both valid and known at its time. Every entity's
history is reduced to the narrow rows at which the best known row changes; a running count of
those changes over (entity, time) rows numbers the versions, and the wide attributes follow by an
equi-join on entity and number. The narrow rows are distinct (entity, day) pairs, so an entity
that owns a third of all events still has no more rows in its window than there are days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import clean_key


def attributes_as_known(
    events: DataFrame,
    attributes: DataFrame,
    *,
    event_id: str,
    event_entity: str,
    event_day: str,
    entity: str,
    valid_from: str,
    known_from: str,
    row_id: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(event_id, row_id, *keep): the attribute row that holds for each event.

    Of the rows valid and known on or before the event's day: the latest valid_from, then the
    latest known_from, then the greatest row_id. Events without entity or day, and events for
    which nothing fits, give no row; attribute rows without entity, date or row_id take no part.
    Repeated rows count once. Other columns of either table are ignored, whatever their names.
    """
    ev = (
        events.select(F.col(event_id).alias("_event"), clean_key(event_entity).alias("_entity"), F.col(event_day).alias("_day"))
        .where("_entity is not null and _day is not null")
        .distinct()
    )
    rows = attributes.select(
        clean_key(entity).alias("_entity"),
        F.struct(F.col(valid_from).alias("v"), F.col(known_from).alias("k"), F.col(row_id).alias("r")).alias("_best"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).where("_entity is not null and _best.v is not null and _best.k is not null and _best.r is not null")

    offered = rows.groupBy("_entity", F.greatest("_best.v", "_best.k").alias("_day")).agg(F.max("_best").alias("_best"))
    asked = ev.select("_entity", "_day").distinct()
    timeline = offered.select("_entity", "_day", F.lit(0).alias("_asks"), "_best").unionByName(
        asked.select("_entity", "_day", F.lit(1).alias("_asks")), allowMissingColumns=True
    )
    order = Window.partitionBy("_entity").orderBy("_day", "_asks")
    before = F.max("_best").over(order.rowsBetween(Window.unboundedPreceding, -1))
    changes = F.col("_best").isNotNull() & (F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    numbered = (
        timeline.withColumn("_before", before)
        .withColumn("_changes", changes)
        .withColumn("_version", F.sum(F.col("_changes").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    versions = numbered.where("_asks = 0 and _changes").select("_entity", "_version", F.col("_best.r").alias("_row"))
    at_event = numbered.where("_asks = 1 and _version > 0").select("_entity", "_day", "_version")
    found = ev.join(at_event, ["_entity", "_day"]).join(versions, ["_entity", "_version"])
    if not keep:
        return found.select(F.col("_event").alias(event_id), F.col("_row").alias(row_id))
    wide = rows.select("_entity", F.col("_best.r").alias("_row"), *[f"_keep_{c}" for c in keep]).dropDuplicates(["_entity", "_row"])
    return found.join(wide, ["_entity", "_row"]).select(
        F.col("_event").alias(event_id), F.col("_row").alias(row_id), *[F.col(f"_keep_{c}").alias(c) for c in keep]
    )


def _stabbing_best(periods: DataFrame, points: DataFrame) -> DataFrame:
    """points (_component, _day) with _best, the greatest of the periods (_component, _from, _until, _best) that cover each.

    Points are numbered per component; a period covers a range of numbers and is cut into at most
    two dyadic blocks a level, a point looks into its one block of each level. So n periods make
    n log n rows, and no period is ever paired with the points inside it. Every _from and every
    _until that is not null must be a point.
    """
    numbered = points.withColumn("_at", (F.row_number().over(Window.partitionBy("_component").orderBy("_day")) - 1).cast("long"))
    first = numbered.select("_component", F.col("_day").alias("_from"), F.col("_at").alias("_lo"))
    last = numbered.select("_component", F.col("_day").alias("_until"), F.col("_at").alias("_hi"))
    top = 32
    levels = F.sequence(F.lit(0), F.lit(top))

    def blocks(level):
        shift = lambda how, c: F.call_function(how, c, level)
        lo = shift("shiftright", F.col("_lo") + shift("shiftleft", F.lit(1).cast("long")) - 1)
        hi = shift("shiftright", F.col("_hi"))
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        left = F.when((lo < hi) & odd(lo), F.struct(level.alias("_level"), lo.alias("_block")))
        right = F.when((lo < hi) & odd(hi), F.struct(level.alias("_level"), (hi - 1).alias("_block")))
        return F.array(left, right)

    ranged = periods.join(first, ["_component", "_from"]).join(last, ["_component", "_until"], "left").withColumn("_hi", F.coalesce("_hi", F.lit(1 << top).cast("long")))
    cut = ranged.select("_component", "_best", F.inline(F.filter(F.flatten(F.transform(levels, blocks)), lambda b: b.isNotNull())))
    held = cut.groupBy("_component", "_level", "_block").agg(F.max("_best").alias("_best"))
    asked = numbered.select("*", F.explode(levels).alias("_level")).withColumn("_block", F.expr("shiftright(_at, _level)"))
    return asked.join(held, ["_component", "_level", "_block"], "left").groupBy("_component", "_day").agg(F.max("_best").alias("_best"))


def periods_in_force(
    events: DataFrame,
    periods: DataFrame,
    *,
    event_id: str,
    event_day: str,
    component: str,
    start: str,
    end: str,
    known_from: str,
    row_id: str,
) -> DataFrame:
    """(event_id, component, row_id): the period row of each component in force on the event's day.

    A row holds from start to end, both inclusive, null end = open, once it is known; of several
    the latest known_from, then the greatest row_id. Days without an answer give no row; rows
    without component, start, known_from or row_id take no part. What is in force can change only
    on the day a row begins to hold or the day after it ends: at those change points the best row
    is found, changes are counted per component over change points and the events' days, and the
    rows follow by component and number. No calendar is laid out, so a day of any century costs
    no more than any other.
    """
    ev = events.select(F.col(event_id).alias("_event"), F.col(event_day).alias("_day")).where("_day is not null").distinct()
    # greatest() skips nulls; a row without start or known day is dropped before
    spans = (
        periods.where(F.col(start).isNotNull() & F.col(known_from).isNotNull() & F.col(component).isNotNull() & F.col(row_id).isNotNull())
        .select(
            F.col(component).alias("_component"),
            F.struct(F.col(known_from).alias("k"), F.col(row_id).alias("r")).alias("_best"),
            F.greatest(F.col(start), F.col(known_from)).alias("_from"),
            F.date_add(F.col(end), 1).alias("_until"),
        )
        .where("_until is null or _from < _until")
        .distinct()
    )
    points = spans.select("_component", F.explode(F.array("_from", "_until")).alias("_day")).where("_day is not null").distinct()
    change_points = _stabbing_best(spans, points).withColumn("_asks", F.lit(0))
    # every event meets every component, so each day of an event is asked once per component
    components = periods.where(F.col(component).isNotNull()).select(F.collect_set(component)).scalar()
    asked = ev.select("_day").distinct().select(F.explode(components).alias("_component"), "_day", F.lit(1).alias("_asks"))
    order = Window.partitionBy("_component").orderBy("_day", "_asks")
    timeline = change_points.unionByName(asked, allowMissingColumns=True)
    # an asking row has no state of its own; of change points the one before is compared
    before = F.last(F.when(F.col("_asks") == 0, F.struct("_best")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    changed = (F.col("_asks") == 0) & (F.col("_before").isNull() | ~F.col("_best").eqNullSafe(F.col("_before._best")))
    numbered = timeline.withColumn("_before", before).withColumn("_changed", changed)
    numbered = numbered.withColumn("_version", F.sum(F.col("_changed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    versions = numbered.where("_changed and _best is not null").select("_component", "_version", F.col("_best.r").alias("_row"))
    at_day = numbered.where("_asks = 1 and _version > 0").select("_component", "_day", "_version")
    return (
        ev.join(at_day.join(versions, ["_component", "_version"]), "_day")
        .select(F.col("_event").alias(event_id), F.col("_component").alias(component), F.col("_row").alias(row_id))
    )
