"""Sinks: write-once tables, dialect files and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.quality import fingerprint


def write_once(df: DataFrame, path: str, *, day: str = "date") -> None:
    """A parquet table by year; fails if the path exists. Rows are brought together by year and a salt."""
    by_year = df.withColumn("year", F.year(day))
    by_year.repartition("year", F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("errorifexists").partitionBy("year").parquet(path)


def write_or_verify(df: DataFrame, path: str) -> bool:
    """Write a table that does not exist (True), or check that it equals what is there (False); raises if not."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df.write.parquet(path)
        return True
    if fingerprint(df).first() != fingerprint(spark.read.parquet(path).select(*df.columns)).first():
        raise ValueError(f"{path} holds other rows")
    return False


def write_bars_csv(df: DataFrame, path: str) -> None:
    """Dialect files of bars, one folder per symbol, put in place by a rename once they are complete."""
    spark = df.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, draft = path_of(path), path_of(f"{path}.draft")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(draft, True)
    df.select("symbol", F.date_format("date", "dd-MM-yyyy HH:mm").alias("Date"), "open", "high", "low", "close", F.col("volume").alias("tick_volume")).write.partitionBy("symbol").csv(f"{path}.draft", header=True)
    backup = path_of(f"{path}.backup")
    if fs.exists(target):
        fs.delete(backup, True)
        fs.rename(target, backup)
    fs.rename(draft, target)


def snapshot_raw(df: DataFrame, path: str, manifest: str, *, kind: str) -> None:
    """An immutable snapshot (fails if it exists) and its row in a JSON-lines manifest: path, kind, rows, checksum."""
    df.write.mode("errorifexists").parquet(path)
    kept = fingerprint(df.sparkSession.read.parquet(path))
    append_log(kept.select(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(200).alias("status"), "rows", F.col("checksum").cast("string").alias("checksum")), manifest)


def append_log(df: DataFrame, path: str) -> None:
    """Rows at the end of a JSON-lines log."""
    df.write.mode("append").json(path)
