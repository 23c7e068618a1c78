"""A random forest on features of past closes, as a 0/1 position."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import indicators as I
from marketloom.session import cut_lineage

FEATURES = ["ret_1", "ret_5", "ret_20", "dist_20", "dist_50", "vol_20"]


def features(bars: DataFrame) -> DataFrame:
    """bars with FEATURES of closes up to the row and target: whether the next close is higher."""
    w = I.by_symbol()
    averages = I.ema(bars, 20, "e20").select("symbol", "ts", "e20").join(I.ema(bars, 50, "e50").select("symbol", "ts", "e50"), ["symbol", "ts"])
    x = bars.join(averages, ["symbol", "ts"])
    x = x.withColumn("ret_1", I.change("close", 1)).withColumn("ret_5", I.change("close", 5)).withColumn("ret_20", I.change("close", 20))
    x = x.withColumn("dist_20", F.try_divide("close", "e20") - 1).withColumn("dist_50", F.try_divide("close", "e50") - 1).withColumn("vol_20", I.full_window(F.stddev_samp, F.col("ret_1"), 20, w))
    return x.withColumn("target", F.coalesce(F.lead("close").over(w) > F.col("close"), F.lit(False)).cast("int")).dropna(subset=FEATURES)


def forest_positions(bars: DataFrame, *, trees: int = 200, least_leaf: int = 20, seed: int = 42) -> DataFrame:
    """The last 30 % of each symbol's rows with the position predicted by a forest of the first 70 %."""
    x = features(bars)
    w = Window.partitionBy("symbol")
    x = x.withColumn("i", F.row_number().over(w.orderBy("ts"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("train", F.col("i") <= F.floor(F.col("n") * 0.7))
    x = cut_lineage(x)  # every level of the trees reads it again
    v = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)
    model = RandomForestClassifier(labelCol="target", numTrees=trees, minInstancesPerNode=least_leaf, seed=seed).fit(v.where("train").sort("symbol", "ts"))
    return model.transform(v.where("not train")).select("symbol", "ts", "open", "close", "target", F.col("prediction").cast("int").alias("position"))
