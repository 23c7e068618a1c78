"""Data-quality rules: flags on bars, defective sessions, conflict gates, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.joins import near_in_time


def bar_flags(bars: DataFrame) -> DataFrame:
    """(rule, symbol, ts): one row per broken rule; nothing is removed.

    V01 repeated day, V03 missing price, V04 impossible range, V05 price not positive, V06 frozen
    bar without volume (if most bars have some), V07 spike that reverts, V09 weekend, V11 large move.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    lr = F.log(F.try_divide("close", F.lag("close").over(w)))
    x = bars.withColumn("lr", lr)
    x = x.withColumn("next_lr", F.lead("lr").over(w)).withColumn("n_day", F.count(F.lit(1)).over(Window.partitionBy("symbol", "ts"))).withColumn("liquid", F.avg((F.col("volume") > 0).cast("int")).over(Window.partitionBy("symbol")) > 0.5)
    any_null = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    rules = {
        "V01": F.col("n_day") > 1,
        "V03": any_null,
        "V04": (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")),
        "V05": F.least("open", "high", "low", "close") <= 0,
        "V06": F.col("liquid") & (F.col("volume") == 0) & (F.col("open") == F.col("close")) & (F.col("high") == F.col("low")),
        "V07": (F.abs("lr") > math.log(1.3)) & (F.abs(F.col("lr") + F.col("next_lr")) < 0.1) & (F.signum("next_lr") == -F.signum("lr")),
        "V09": F.weekday("ts") >= 5,
        "V11": F.abs("lr") > math.log(1.2),
    }
    hit = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return x.select(F.explode(hit).alias("rule"), "symbol", "ts")


def split_defective(bars: DataFrame, times: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean bars, defective sessions with reasons): a defect removes only its symbol and session."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    per = bars.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("time").alias("k"), F.count_if(bad).alias("bad"), F.count_if(F.col("time").isin(times)).alias("on_grid"))
    reasons = F.concat_ws(",", F.when(F.col("n") > F.col("k"), "duplicate"), F.when(F.col("bad") > 0, "impossible"), F.when(F.col("on_grid") < len(times), "incomplete"))
    judged = per.select("symbol", "session", reasons.alias("reasons"))
    broken = judged.where("reasons != ''")
    return bars.join(broken, ["symbol", "session"], "left_anti"), broken


def merge_bars(existing: DataFrame, incoming: DataFrame, *, max_overlap: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): only new days are added, existing rows win; symbols whose overlap disagrees are held back."""
    old = existing.select("symbol", "ts", F.col("close").alias("_old"))
    both = incoming.join(old, ["symbol", "ts"])
    conflicts = both.where(F.abs(F.try_divide("close", "_old") - 1) > max_overlap).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_conflicts"))
    fresh = incoming.join(conflicts, "symbol", "left_anti").join(old.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    return existing.unionByName(fresh), conflicts


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, checksum): independent of the order of rows and of partitions."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("checksum"), F.sum(F.shiftright(h, 32)).alias("total"))


def unexplained_jumps(bars: DataFrame, events: DataFrame, *, ratio: float = 1.4, days: int = 10) -> DataFrame:
    """(symbol, ts, lr, explained): moves beyond the ratio, and whether an event lies within the days."""
    w = Window.partitionBy("symbol").orderBy("ts")
    x = bars.select("symbol", "ts", F.log(F.try_divide("close", F.lag("close").over(w))).alias("lr")).where(F.abs("lr") > math.log(ratio))
    near = near_in_time(x, events, "symbol", "ts", "ex_date", days, "explained")
    return near.groupBy("symbol", "ts", "lr").agg(F.bool_or("explained").alias("explained"))


def require(df: DataFrame, condition, message: str) -> DataFrame:
    """df, but its evaluation raises where the condition is not true."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
