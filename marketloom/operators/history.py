"""Type-two history of changing entity attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import clean_key

OPEN_END = "9999-12-31"
FIRST_DAY = "0001-01-01"


def merge_history(
    dimension: DataFrame | None,
    readings: DataFrame,
    *,
    key: tuple[str, ...],
    attributes: tuple[str, ...],
    day: str,
    precedence: Column,
) -> DataFrame:
    """(*key, *attributes, valid_from, valid_to, read_on): the dimension after a batch of readings.

    Each reading says what its entity carried on a day. Of several readings of one entity and day
    the greatest precedence holds, whichever batch brought it. Readings are compared by attribute
    hash with the version current on their day: an equal one confirms it, a different one closes
    it (valid_to is exclusive) and opens a new version, the last one open to 9999-12-31. read_on
    keeps the days on which a version was read, each with its precedence, so that a late reading
    inside a version splits it and what was read afterwards opens again: batches in any order give
    what one batch of all readings gives. Entities that the batch does not name pass through
    untouched. Rows without key or day take no part; null attributes are values like others.

    Readings are pre-aggregated to one per entity and day before the window, so the window of the
    busiest entity holds no more rows than days.
    """
    named = [*key, *attributes]
    batch = readings.select(*named, F.col(day).cast("date").alias("_day"), precedence.alias("_rank")).dropna(subset=[*key, "_day"])
    untouched = None
    if dimension is not None:
        touched = batch.select(*key).distinct()
        untouched = dimension.join(touched, list(key), "left_anti")
        stored = dimension.join(touched, list(key), "left_semi").select(*named, F.explode("read_on").alias("_read"))
        batch = batch.unionByName(stored.select(*named, F.col("_read.day").alias("_day"), F.col("_read.rank").alias("_rank")))
    daily = (
        batch.groupBy(*key, "_day")
        .agg(F.max(F.struct("_rank", *attributes)).alias("_best"))
        .select(*key, "_day", F.col("_best._rank").alias("_rank"), *[F.col("_best")[a].alias(a) for a in attributes])
    )
    order = Window.partitionBy(*key).orderBy("_day")
    digest = F.sha2(F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}), 256)
    numbered = (
        daily.withColumn("_hash", digest)
        .withColumn("_differs", (~F.col("_hash").eqNullSafe(F.lag("_hash").over(order))).cast("int"))
        .withColumn("_version", F.sum("_differs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    opened = numbered.groupBy(*key, "_version").agg(
        *[F.first(a).alias(a) for a in attributes], F.min("_day").alias("valid_from"), F.array_sort(F.collect_list(F.struct(F.col("_day").alias("day"), F.col("_rank").alias("rank")))).alias("read_on")
    )
    closes = F.lead("valid_from").over(Window.partitionBy(*key).orderBy("_version"))
    merged = opened.withColumn("valid_to", F.coalesce(closes, F.to_date(F.lit(OPEN_END)))).select(*named, "valid_from", "valid_to", "read_on")
    return merged if untouched is None else merged.unionByName(untouched.select(*merged.columns))


ISIN = r"([A-Za-z]{2}[A-Za-z0-9]{9}[0-9])"
_DIFFERS = rf"(?i)\b{ISIN}\s*(?:!=|<>|≠)\s*{ISIN}\b"
_BECOMES = rf"(?i)\b{ISIN}\s*(?:->|=>|→)\s*{ISIN}\b"
_FROM_TO = rf"(?i)\bfrom\s+{ISIN}\s+to\s+{ISIN}\b"
_REPLACES = rf"(?i)\b{ISIN}\s+replaces\s+{ISIN}\b"
_DATES = (
    (r"(?<![0-9A-Za-z-])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z-])", "yyyy-MM-dd"),
    (r"(?<![0-9A-Za-z-])([0-9]{1,2}-[A-Za-z]{3}-[0-9]{4})(?![0-9A-Za-z-])", "d-MMM-yyyy"),
    (r"(?<![0-9A-Za-z-])([0-9]{1,2} [A-Za-z]{3} [0-9]{4})(?![0-9A-Za-z-])", "d MMM yyyy"),
    (r"(?<![0-9A-Za-z-])([0-9]{1,2} [A-Za-z]{4,9} [0-9]{4})(?![0-9A-Za-z-])", "d MMMM yyyy"),
    (r"(?<![0-9A-Za-z-])([0-9]{8})(?![0-9A-Za-z-])", "yyyyMMdd"),
)


def isin_change(detail: Column) -> tuple[Column, Column, Column]:
    """(old, new, day) named by a free text; nulls where it names no such change."""
    pairs = [(p, 1, 2) for p in (_DIFFERS, _BECOMES, _FROM_TO)] + [(_REPLACES, 2, 1)]

    def part(which: int) -> Column:
        return F.upper(F.coalesce(*[F.when(F.regexp_extract(detail, p, 1) != "", F.regexp_extract(detail, p, (a, b)[which])) for p, a, b in pairs]))

    # month names of May fit both the short and the long form
    texts = [(F.regexp_extract(detail, p, 1), form) for p, form in _DATES]
    day = F.coalesce(*[F.when(t != "", F.to_date(F.try_to_timestamp(F.initcap(t) if "MMM" in form else t, F.lit(form)))) for t, form in texts])
    return part(0), part(1), day


def symbol_readings(resolutions: DataFrame) -> DataFrame:
    """(attribute, entity_id, value, day, said_on, said_by, role): two readings of each resolved row."""
    base = resolutions.select(clean_key("entity_id").alias("entity_id"), "symbol", "historical_symbol", "ex_date", "recorded_on", "res_id").where(
        "entity_id is not null"
    )
    both = F.array(
        F.struct(F.upper(clean_key("historical_symbol")).alias("value"), F.col("ex_date").alias("day"), F.lit(0).alias("role")),
        F.struct(F.upper(clean_key("symbol")).alias("value"), F.col("recorded_on").alias("day"), F.lit(1).alias("role")),
    )
    return (
        base.select(F.lit("symbol").alias("attribute"), "entity_id", F.inline(both), F.col("recorded_on").alias("said_on"), F.col("res_id").alias("said_by"))
        .where("value is not null and day is not null")
        .select("attribute", "entity_id", "value", "day", "said_on", "said_by", "role")
    )


def isin_readings(flags: DataFrame, segments: DataFrame) -> DataFrame:
    """The same columns for the ISIN changes that flags report.

    Of several reports of one change of an entity the latest flagged_on, then the greatest
    flag_id names the day. The old ISIN of an entity's first change is read on 0001-01-01.
    """
    old, new, day = isin_change(F.col("detail"))
    named = (
        flags.select(clean_key("segment_id").alias("segment_id"), old.alias("old"), new.alias("new"), day.alias("day"), "flagged_on", "flag_id")
        .where("old is not null and new is not null and old != new and day is not null and segment_id is not null")
        .distinct()
    )
    owner = segments.select(clean_key("segment_id").alias("segment_id"), clean_key("entity_id").alias("entity_id")).where("entity_id is not null").dropDuplicates(["segment_id"])
    changes = (
        named.join(owner, "segment_id")
        .groupBy("entity_id", "old", "new")
        .agg(F.max(F.struct("flagged_on", "flag_id", "day")).alias("_said"))
        .select("entity_id", "old", "new", "_said.*")
    )
    first = Window.partitionBy("entity_id").orderBy("day", "flagged_on", "flag_id")
    begins = F.when(
        F.row_number().over(first) == 1, F.struct(F.col("old").alias("value"), F.to_date(F.lit(FIRST_DAY)).alias("day"))
    )
    both = F.filter(F.array(begins, F.struct(F.col("new").alias("value"), F.col("day"))), lambda x: x.isNotNull())
    return (
        changes.withColumn("_both", both)
        .select(F.lit("isin").alias("attribute"), "entity_id", F.inline("_both"), F.col("flagged_on").alias("said_on"), F.col("flag_id").alias("said_by"))
        .select("attribute", "entity_id", "value", "day", "said_on", "said_by", F.lit(0).alias("role"))
    )


def identifier_history(resolutions: DataFrame, flags: DataFrame, segments: DataFrame, *, batches: int = 2) -> DataFrame:
    """(attribute, entity_id, value, valid_from, valid_to): every symbol and ISIN of every entity.

    The dimension is built as it would have been kept: readings come in batches, by equal spans of
    the day they were said on, and each batch is merged into the dimension of the ones before,
    late readings included. The number of batches changes nothing in the result.
    """
    readings = symbol_readings(resolutions).unionByName(isin_readings(flags, segments))
    bounds = resolutions.select(F.col("recorded_on").alias("d")).unionByName(flags.select(F.col("flagged_on").alias("d"))).agg(F.min("d"), F.max("d")).first()
    lo, hi = bounds if bounds and bounds[0] is not None else (None, None)
    cuts = [] if lo is None else [lo + (hi - lo) * i / batches for i in range(1, batches)]
    dimension = None
    for since, until in zip([None, *cuts], [*cuts, None]):
        part = readings
        if until is not None:
            part = part.where(F.col("said_on").isNull() | (F.col("said_on") <= F.lit(until)))
        if since is not None:
            part = part.where(F.col("said_on") > F.lit(since))
        dimension = merge_history(dimension, part, key=("attribute", "entity_id"), attributes=("value",), day="day", precedence=F.struct("said_on", "said_by", "role"))
    return dimension.select("attribute", "entity_id", "value", "valid_from", "valid_to")
