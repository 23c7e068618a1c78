"""Inference on series: robust mean tests, multiple testing, bootstrap, deflated Sharpe.

Sums over the data are Spark aggregates; what is done on the driver works on those few numbers.
Bootstrap replicates are spread over tasks, each with a seed of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NORMAL = NormalDist()


def newey_west(series: DataFrame, group: str, order: str, value: str, lag: int) -> DataFrame:
    """(group, n, mean, lrv, t): mean and long-run variance with Bartlett weights, autocovariances over n."""
    w, all_ = Window.partitionBy(group).orderBy(order), Window.partitionBy(group)
    x = series.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(all_)).withColumn("_d", F.col(value) - F.col("_m"))
    terms = F.col("_d") * F.col("_d")
    for k in range(1, lag + 1):
        terms = terms + 2.0 * (1 - k / (lag + 1)) * F.coalesce(F.col("_d") * F.lag("_d", k).over(w), F.lit(0.0))
    g = x.withColumn("_t", terms).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.sum("_t") / F.count(F.lit(1))).alias("lrv"))
    return g.withColumn("t", F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))))


def lag_rule(n: int) -> int:
    return math.floor(4 * (n / 100) ** (2 / 9))


def two_sided_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def holm(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Holm's adjusted p: step-down running maximum; ties by key."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, key)
    x = tests.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return x.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("_n") - F.col("_i") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_i", "_n")


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Adjusted p by Benjamini and Hochberg: step-up running minimum."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, key)
    x = tests.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return x.withColumn("bh", F.least(F.lit(1.0), F.min(F.col("_n") * F.col(p) / F.col("_i")).over(w.rowsBetween(0, Window.unboundedFollowing)))).drop("_i", "_n")


def block_length(acov: list[float], n: int) -> float:
    """Expected block of the stationary bootstrap by Politis and White, from autocovariances over n.

    Flat-top weights; the first lag after which a stretch of correlations is insignificant; the
    result lies between 1 and the usual bound. Needs lags up to ceil(sqrt n) + 2 kn.
    """
    if n < 8:
        raise ValueError("at least 8 observations are needed")
    if not acov[0] > 0:
        return 1.0
    kn = max(5, math.ceil(math.sqrt(math.log10(n))))
    most = math.ceil(math.sqrt(n)) + kn
    bound = 2 * math.sqrt(math.log10(n) / n)
    rho = np.abs(np.array(acov) / acov[0])
    quiet = [m for m in range(1, most + 1) if (rho[m + 1 : m + 1 + kn] < bound).all()]
    width = min(2 * (quiet[0] if quiet else most), most)
    k = np.arange(1, width + 1)
    weight = np.clip(2 * (1 - k / width), 0, 1)
    tail = weight * np.array(acov)[1 : width + 1]
    slope, level = 2 * float((tail * k).sum()), acov[0] + 2 * float(tail.sum())
    if slope == 0 or level == 0:
        return 1.0
    return float(min(max((slope**2 / level**2) ** (1 / 3) * n ** (1 / 3), 1.0), math.ceil(min(3 * math.sqrt(n), n / 3))))


def bootstrap_means(spark, values: list[float], mean_block: float, replicates: int, seed: int, *, per_task: int = 500) -> DataFrame:
    """(replicate, mean): stationary bootstrap with circular geometric blocks.

    The series is a calendar's worth of numbers; replicates are spread over tasks and each chunk
    has its own seed sequence, so the result does not depend on how tasks run.
    """
    x = np.asarray(values, dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk in b["id"]:
                lo = int(chunk) * per_task
                m = min(per_task, replicates - lo)
                rng = np.random.default_rng([seed, int(chunk)])
                yield pd.DataFrame({"replicate": np.arange(lo, lo + m), "mean": _resampled_means(x, mean_block, m, rng)})

    chunks = -(-replicates // per_task)
    return spark.range(0, chunks, 1, chunks).mapInPandas(run, "replicate long, mean double")


def one_sided_p(observed: float, means: DataFrame) -> DataFrame:
    """(p, lower, upper): null-centred p with +1 smoothing, and the 5 and 95 % points of the means."""
    above = F.count_if(F.col("mean") - observed >= observed)
    return means.agg(((above + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.expr("percentile(mean, 0.05)").alias("lower"), F.expr("percentile(mean, 0.95)").alias("upper"))


def bootstrap(series: DataFrame, group: str, order: str, value: str, *, replicates: int, seed: int, per_task: int = 500, alpha: float = 0.05) -> DataFrame:
    """(group, n, mean, block, p_one_sided, p_two_sided, lower, upper, verdict) of the mean of every group.

    A group's series, one number per session of a calendar, travels as one array to the tasks of
    its replicates; each chunk of replicates has a seed of its own, so the result does not depend
    on how tasks run. p is centred on the null with +1 smoothing; groups of fewer than 8 values
    are left out. POSITIVE: the lower bound of the means is above 0, NEGATIVE: the upper below it.
    """
    packed = series.where(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double")).alias("x")).where(F.size("x") >= 8)
    chunks = -(-replicates // per_task)
    spread = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition("g", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, values, chunk in zip(b["g"], b["x"], b["chunk"]):
                x = np.asarray(values, dtype=float)
                n, dev = len(x), np.asarray(values, dtype=float) - np.mean(values)
                lags = min(n - 1, math.ceil(math.sqrt(n)) + 2 * max(5, math.ceil(math.sqrt(math.log10(n)))) + 1)
                acov = [float(dev[: n - k] @ dev[k:]) / n for k in range(lags + 1)] + [0.0] * 64
                block = block_length(acov, n)
                m = min(per_task, replicates - int(chunk) * per_task)
                means = _resampled_means(x, block, m, np.random.default_rng([seed, int(chunk)]))
                yield pd.DataFrame({"g": name, "n": n, "observed": float(x.mean()), "block": block, "mean": means})

    means = spread.mapInPandas(run, "g string, n long, observed double, block double, mean double")
    centred = F.col("mean") - F.col("observed")
    out = means.groupBy("g", "n", "observed", "block").agg(
        ((F.count_if(centred >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_one_sided"),
        ((F.count_if(F.abs(centred) >= F.abs("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_two_sided"),
        F.expr(f"percentile(mean, {alpha})").alias("lower"),
        F.expr(f"percentile(mean, {1 - alpha})").alias("upper"),
    )
    verdict = F.when(F.col("lower") > 0, "POSITIVE").when(F.col("upper") < 0, "NEGATIVE").otherwise("INCONCLUSIVE")
    return out.withColumn("verdict", verdict).withColumnRenamed("g", group).withColumnRenamed("observed", "mean")


def _resampled_means(x: np.ndarray, mean_block: float, m: int, rng: np.random.Generator) -> np.ndarray:
    """m means of stationary resamples: circular blocks of geometric length."""
    n = len(x)
    jump = rng.random((m, n)) < 1.0 / max(float(mean_block), 1.0)
    jump[:, 0] = True
    begun = np.maximum.accumulate(np.where(jump, np.arange(n)[None, :], 0), axis=1)
    start = np.take_along_axis(rng.integers(0, n, (m, n)), begun, axis=1)
    return x[(start + np.arange(n)[None, :] - begun) % n].mean(axis=1)


def deflated_sharpe(series: DataFrame, group: str, value: str, n_trials: int) -> DataFrame:
    """(group, n, sr, skew, kurtosis, z): moments and the deflated score; its probability is normal in z."""
    g = series.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurtosis"))
    euler = 0.5772156649015329
    lucky = 0.0 if n_trials <= 1 else (1 - euler) * NORMAL.inv_cdf(1 - 1 / n_trials) + euler * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e))
    g = g.where("n > 2 and sd > 0").withColumn("sr", F.col("m") / F.col("sd"))
    spread = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.col("sr") ** 2, F.lit(1e-12)))
    return g.withColumn("z", (F.col("sr") - F.sqrt(1 / (F.col("n") - 1)) * lucky) * F.sqrt(F.col("n") - 1) / spread).select(group, "n", "sr", "skew", "kurtosis", "z")


def root(f, low: float, high: float, tolerance: float = 1e-9) -> float | None:
    """Bisection on a bracket with a change of sign; None without one."""
    a, b = f(low), f(high)
    if a == 0 or b == 0:
        return low if a == 0 else high
    if (a > 0) == (b > 0):
        return None
    while high - low > tolerance:
        mid = (low + high) / 2
        low, high = (mid, high) if (f(mid) > 0) == (a > 0) else (low, mid)
    return (low + high) / 2
