"""Moving averages, oscillators and other functions of ordered series.

Every function adds columns to bars with symbol, ts and close; all windows of one call share the
exchange on symbol. Recursive ones pass once over a symbol's series as an array.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTIL_NOW = (Window.unboundedPreceding, Window.currentRow)


def by_symbol(key: str = "symbol", order: str = "ts"):
    return Window.partitionBy(key).orderBy(order)


def full_window(agg, c: Column, n: int, w) -> Column:
    """An aggregate over exactly n rows; null for the first n - 1."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def sma(bars: DataFrame, n: int, name: str | None = None) -> DataFrame:
    return bars.withColumn(name or f"sma_{n}", full_window(F.avg, F.col("close"), n, by_symbol()))


def running(bars: DataFrame, name: str, of, value: str = "close", key: str = "symbol", order: str = "ts") -> DataFrame:
    """bars with a double column name = of(pandas series of value in order), one vectorised pass per key.

    One group is held at a time, as long as its sessions; time grows with its rows, not their square.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields) + f", `{name}` double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.assign(**{name: of(rows[value].astype(float))})

    return bars.groupBy(key).applyInPandas(run, schema)


def ema(bars: DataFrame, n: int, name: str | None = None) -> DataFrame:
    """Exponential average with factor 2 / (n + 1), started at the first close; no warm-up nulls."""
    return running(bars, name or f"ema_{n}", lambda x: x.ewm(alpha=2.0 / (n + 1), adjust=False).mean())


def expanding_median(rows: DataFrame, value: str, name: str, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Median of all values up to each row, nulls aside; an ordered structure keeps it in n log n."""
    return running(rows, name, lambda x: x.expanding().median(), value, key, order)


def crossover(bars: DataFrame, fast: str, slow: str) -> DataFrame:
    """position 1 while fast is above slow; missing averages count as 0."""
    return bars.withColumn("position", F.coalesce(F.col(fast) > F.col(slow), F.lit(False)).cast("int"))


def change(c: str, k: int, w=None) -> Column:
    w = w or by_symbol()
    return F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1


def drawdown(c: str, w=None) -> Column:
    """Distance from the running maximum as a share of it."""
    peak = F.max(c).over((w or by_symbol()).rowsBetween(*UNTIL_NOW))
    return F.try_divide(F.col(c) - peak, peak)


def wilder_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by Wilder: seeded with the simple mean of the first n moves."""
    w = by_symbol()
    moves = bars.withColumn("move", F.col("close") - F.lag("close").over(w)).withColumn("i", F.row_number().over(w) - 1)
    first = Window.partitionBy("symbol")
    up, down = F.greatest(F.col("move"), F.lit(0.0)), F.greatest(-F.col("move"), F.lit(0.0))
    seeded = moves.where("i >= 1").withColumn("gain0", F.sum(F.when(F.col("i") <= n, up)).over(first) / n).withColumn("loss0", F.sum(F.when(F.col("i") <= n, down)).over(first) / n)
    tail = F.array_sort(F.collect_list(F.when(F.col("i") > n, F.struct("i", up.alias("u"), down.alias("d")))))
    packed = seeded.groupBy("symbol", "gain0", "loss0").agg(tail.alias("rows"), F.max("i").alias("m")).where(F.col("m") >= n)
    last = F.aggregate(
        "rows",
        F.struct(F.col("gain0").alias("g"), F.col("loss0").alias("l")),
        lambda s, x: F.struct(((s["g"] * (n - 1) + x["u"]) / n).alias("g"), ((s["l"] * (n - 1) + x["d"]) / n).alias("l")),
    )
    packed = packed.withColumn("s", last)
    return packed.select("symbol", F.when(F.col("s.l") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col("s.g"), F.col("s.l")))).alias("rsi"))
