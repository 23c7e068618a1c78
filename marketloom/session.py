"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a local session without one gets a private one.

    On a cluster a folder of one machine would lose data with it, so there the setting is required.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marketloom-ckpt-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table into the shared checkpoint folder and read it back: (table, path).

    For loops: unlike checkpoint(), the new plan carries no constraints of the old one, and the
    files can be removed with drop_written() once the next round stands.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, *paths: str) -> None:
    """Remove tables of write_out()."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean_key(column: Column | str) -> Column:
    """A key without the blanks around it; otherwise exact. A key of blanks only becomes null."""
    trimmed = F.btrim(column if isinstance(column, Column) else F.col(column), F.lit(BLANKS))
    return F.when(trimmed != "", trimmed)


def known(column: Column | str) -> Column:
    """NaN as null: the tables hold both for a missing number."""
    c = column if isinstance(column, Column) else F.col(column)
    return F.when(~F.isnan(c), c)
