"""The best N items of every group, with a fixed tie rule.

A histogram of scores per group gives a threshold that at least N items reach; rows beyond it are
filtered before any sort. What survives is ranked in salted parts first, so that a group whose
items all tie never meets in one task; the parts' best N are then ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(items: DataFrame, group: list[str], score: str, tie: list[str], n: int, *, descending: bool = False, salts: int = 32, bins_per_octave: int = 8) -> DataFrame:
    """items (group, score, tie) with place 1 to n: by score, the smallest first or with descending the greatest, then the tie columns ascending.

    Scores may have either sign. Rows with a null or NaN score or a null group column take no
    part; infinities are scores like others. Rows equal in score and all tie columns are ranked in
    no defined order. A bin holds scores of one sign within a factor of 2 ** (1 / bins_per_octave)
    of 1 + their size, so a group has at most a few ten thousand bins.
    """
    number = F.col(score).cast("double")
    rows = items.select(*group, score, *tie).dropna(subset=[*group, score]).where(~F.isnan(number))
    size = F.least(F.abs(number), F.lit(1.7976931348623157e308))
    upward = F.signum(number) * F.floor(F.log2(size + 1.0) * bins_per_octave)
    rows = rows.withColumn("_bin", (-upward if descending else upward).cast("int"))
    histogram = rows.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    reach = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin"))
    # the last bin that starts with fewer than n items before it still belongs to the best n
    threshold = histogram.withColumn("_before", reach - F.col("_n")).where(F.col("_before") < n).groupBy(*group).agg(F.max("_bin").alias("_last"))
    survivors = rows.join(threshold, group).where("_bin <= _last").drop("_bin", "_last")
    order = [F.col(score).desc() if descending else F.col(score), *[F.col(t) for t in tie]]
    salted = survivors.withColumn("_salt", F.pmod(F.xxhash64(*tie) if tie else F.xxhash64(score), F.lit(salts)))
    parts = salted.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("_place") <= n)
    return parts.drop("_place", "_salt").withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def admissible_ranks(universe: DataFrame) -> DataFrame:
    """(pool, selection_date, entity_id, rank): the row of each entity that counts, if admissible.

    Of an entity's rows in a selection the latest recorded_on, then the greatest univ_id counts;
    it is admissible with a rank >= 1 and status MEMBER or ELIGIBLE_NOT_SELECTED, case and blanks
    aside. Rows without pool, selection_date or entity take no part.
    """
    status = F.upper(F.btrim("status", F.lit(" \t\r\n"))).isin("MEMBER", "ELIGIBLE_NOT_SELECTED")
    good = F.coalesce(status, F.lit(False)) & F.coalesce((F.col("rank") >= 1) & ~F.isnan("rank"), F.lit(False))
    rows = universe.select("pool", "selection_date", "entity_id", "recorded_on", "univ_id", F.when(good, F.col("rank")).alias("rank"))
    return (
        rows.dropna(subset=["pool", "selection_date", "entity_id"])
        .groupBy("pool", "selection_date", "entity_id")
        .agg(F.max(F.struct("recorded_on", "univ_id", "rank")).alias("_last"))
        .select("pool", "selection_date", "entity_id", F.col("_last.rank").alias("rank"))
        .where("rank is not null")
    )
