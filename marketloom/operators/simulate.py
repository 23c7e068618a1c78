"""Random baselines of trading results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sign_flip(trades: DataFrame, *, key: list[str], replicates: int, seed: int) -> DataFrame:
    """(observed, replicates, at_least, p): the net result against coin-flipped gross results.

    Costs are not flipped. The coin of a trade in a replicate is a bit of a hash of its key, the
    seed and the replicate, so it does not depend on partitions. Each task adds up its own part of
    every replicate, a bounded block of trades at a time: only replicates x tasks numbers are
    shuffled, however many trades there are.
    """
    net = F.col("gross_pnl") - F.col("slippage") - F.col("total_charges")
    words = -(-replicates // 64)
    block = max(1, 4_000_000 // (64 * words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(64 * words)
        salt = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for b in batches:
            gross = b["gross_pnl"].to_numpy(dtype=float)
            h = b["_key"].to_numpy(dtype=np.int64).view(np.uint64)
            for lo in range(0, len(gross), block):
                x = h[lo : lo + block, None] ^ salt
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                coins = np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1
                total += gross[lo : lo + block] @ coins
            total -= (b["slippage"] + b["total_charges"]).sum()
        yield pd.DataFrame({"replicate": np.arange(replicates), "net": total[:replicates]})

    keyed = trades.select("gross_pnl", "slippage", "total_charges", F.xxhash64(F.lit(seed), *key).alias("_key"))
    draws = keyed.mapInPandas(run, "replicate long, net double").groupBy("replicate").agg(F.sum("net").alias("net"))
    observed = trades.agg(F.sum(net)).scalar()
    x = draws.withColumn("observed", observed)
    return x.groupBy("observed").agg(F.count(F.lit(1)).alias("replicates"), F.count_if(F.col("net") >= F.col("observed")).alias("at_least")).withColumn("p", (F.col("at_least") + 1) / (F.col("replicates") + 1))


def random_entry(bars: DataFrame, *, first: str, last: str, exit_time: str, replicates: int) -> DataFrame:
    """(replicate, n, gross): per replicate one random bar and side in each session, out at exit_time's open.

    The draw is a hash of symbol, session and replicate, so it stays on the JVM, does not depend on
    partitions, and repeats. Sessions without the exit bar or an eligible bar take no part.
    """
    eligible = F.col("time").between(first, last)
    per = bars.groupBy("symbol", "session").agg(
        F.array_sort(F.collect_list(F.when(eligible, F.struct("time", "open")))).alias("bars"), F.max(F.when(F.col("time") == exit_time, F.col("open"))).alias("out")
    )
    per = per.where((F.size("bars") > 0) & F.col("out").isNotNull())
    x = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = F.xxhash64("symbol", "session", "replicate")
    entry = F.get("bars", F.pmod(F.shiftright(draw, 8), F.size("bars")).cast("int"))["open"]
    side = F.when(F.pmod(draw, F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return x.select("replicate", (side * (F.col("out") - entry)).alias("g")).groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("gross"))
