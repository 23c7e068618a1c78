"""References to records that do not exist.

A keyed ledger holds, per key space, every distinct (table, key, day) that refers to a parent and
what was found for it. New references probe the parent index; parents that arrive or go make the
references of their keys be looked at again, so that waiting orphans are resolved and sound
references reopened. A look is one running sum over the key's days: registrations and removals
are summed by (key, day) first, so a key that owns a third of all references has no more rows
than days, and no parent is ever paired with a reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import cut_lineage

REFERENCE = ("space", "ref_key", "ref_table", "day")
MISSING, LATE, DELETED = "MISSING", "LATE", "DELETED"


@dataclass
class OrphanLedger:
    """references: REFERENCE + cause (null = sound); parents: space, parent_id, ref_key, registered_on, removed_on."""

    references: DataFrame
    parents: DataFrame


def probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """references with their cause: no parent at all, none registered by the day, or all removed by it.

    A parent without registered_on counts as always registered, one without removed_on as never
    removed.
    """
    enters = F.coalesce("registered_on", F.to_date(F.lit("0001-01-01")))
    moves = F.array(
        F.struct(enters.alias("day"), F.lit(1).alias("active"), F.lit(1).alias("seen")),
        F.struct(F.greatest(enters, F.col("removed_on")).alias("day"), F.when(F.col("removed_on").isNotNull(), -1).otherwise(0).alias("active"), F.lit(0).alias("seen")),
    )
    steps = (
        parents.select("space", "ref_key", F.inline(moves))
        .groupBy("space", "ref_key", "day")
        .agg(F.sum("active").alias("active"), F.sum("seen").alias("seen"))
        .withColumn("asks", F.lit(0))
    )
    asked = references.select(*REFERENCE, F.lit(0).cast("long").alias("active"), F.lit(0).cast("long").alias("seen"), F.lit(1).alias("asks"))
    key = Window.partitionBy("space", "ref_key")
    run = key.orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    looked = steps.unionByName(asked, allowMissingColumns=True)
    looked = (
        looked.withColumn("_known", F.min("asks").over(key.orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 0)
        .withColumn("_active", F.sum("active").over(run))
        .withColumn("_seen", F.sum("seen").over(run))
    )
    cause = F.when(~F.col("_known"), MISSING).when(F.col("_seen") == 0, LATE).when(F.col("_active") <= 0, DELETED)
    return looked.where("asks = 1").select(*REFERENCE, cause.alias("cause"))


def advance(ledger: OrphanLedger | None, references: DataFrame, parents: DataFrame) -> OrphanLedger:
    """The ledger after a batch of new references and of new or changed parents.

    Rows without key or day take no part; repeated ones count once; a parent row replaces the
    older row of its parent_id in its space.
    """
    new = references.dropna(subset=["space", "ref_key", "day"]).select(*REFERENCE).distinct()
    changed = parents.dropna(subset=["space", "ref_key", "parent_id"]).select("space", "parent_id", "ref_key", "registered_on", "removed_on")
    # of copies of one parent in a batch the greatest row counts
    changed = changed.groupBy("space", "parent_id").agg(F.max(F.struct("ref_key", "registered_on", "removed_on")).alias("_p")).select("space", "parent_id", "_p.*")
    if ledger is None:
        return OrphanLedger(probe(new, changed), changed)
    kept = ledger.parents.join(changed.select("space", "parent_id"), ["space", "parent_id"], "left_anti")
    index = kept.unionByName(changed)
    moved = ledger.parents.join(changed.select("space", "parent_id"), ["space", "parent_id"], "left_semi").select("space", "ref_key")
    touched = changed.select("space", "ref_key").unionByName(moved).distinct()
    again = ledger.references.join(touched, ["space", "ref_key"], "left_semi").select(*REFERENCE)
    rest = ledger.references.join(touched, ["space", "ref_key"], "left_anti")
    fresh = new.join(rest.select(*REFERENCE), list(REFERENCE), "left_anti")
    # only the keys of the increment are looked at; Spark broadcasts them as long as they are few
    looked = again.unionByName(fresh).distinct()
    near = index.join(touched.unionByName(new.select("space", "ref_key")).distinct(), ["space", "ref_key"], "left_semi")
    return OrphanLedger(rest.unionByName(probe(looked, near)), index)


def snapshot(ledger: OrphanLedger) -> DataFrame:
    """(ref_table, period, ref_key, cause): the orphans per table and month, each once."""
    return ledger.references.where("cause is not null").select("ref_table", F.date_format("day", "yyyy-MM").alias("period"), "ref_key", "cause").distinct()


def snapshot_counts(ledger: OrphanLedger) -> DataFrame:
    """(ref_table, period, cause, n_keys): orphan keys per table, month and cause."""
    return snapshot(ledger).groupBy("ref_table", "period", "cause").agg(F.count(F.lit(1)).alias("n_keys"))


def replay_periods(references: DataFrame, parents: DataFrame, *, increments: int = 2) -> list[tuple[date | None, OrphanLedger]]:
    """(last day, ledger) after each of equal spans of days, in time order; None where there are no days.

    Each span brings the references of its days, the parents registered in it and, by a second
    arrival, those removed in it; the last one also what is dated after the last reference.
    """
    references = cut_lineage(references.dropna(subset=["space", "ref_key", "day"]).select(*REFERENCE).distinct())
    span = references.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span["lo"] is None:
        return [(None, advance(None, references, parents))]
    ends = [span["lo"] + (span["hi"] - span["lo"]) * i / increments for i in range(1, increments)]
    out, ledger = [], None
    for since, until in zip([None, *ends], [*ends, None]):

        def within(c, since=since, until=until):
            low = F.lit(True) if since is None else c > F.lit(since)
            return low if until is None else low & (c <= F.lit(until))

        registered = F.coalesce("registered_on", F.to_date(F.lit("0001-01-01")))
        removed = F.coalesce(within(F.col("removed_on")), F.lit(False))
        batch = parents.where(within(registered) | (removed & (registered <= F.lit(until) if until is not None else F.lit(True))))
        if until is not None:
            batch = batch.withColumn("removed_on", F.when(F.col("removed_on") <= F.lit(until), F.col("removed_on")))
        ledger = advance(ledger, references.where(within(F.col("day"))), batch)
        if until is not None:
            ledger = OrphanLedger(cut_lineage(ledger.references), cut_lineage(ledger.parents))
        out.append((until or span["hi"], ledger))
    return out


def replay(references: DataFrame, parents: DataFrame, *, increments: int = 2) -> OrphanLedger:
    """The ledger after all increments; their number does not change it."""
    return replay_periods(references, parents, increments=increments)[-1][1]


def periodic_counts(references: DataFrame, parents: DataFrame, *, increments: int = 4) -> DataFrame:
    """(as_of, ref_table, period, cause, n_keys): the counts of orphans as they stood at the end of each increment."""
    parts = [snapshot_counts(ledger).select(F.lit(day).cast("date").alias("as_of"), "ref_table", "period", "cause", "n_keys") for day, ledger in replay_periods(references, parents, increments=increments)]
    return reduce(DataFrame.unionByName, parts)
