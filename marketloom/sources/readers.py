"""Readers of bar files, exchange archives, corporate actions and lists."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.subjects import subject_kind_factor

BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]
#: Minutes of the suffixes of intraday file names.
TIMEFRAMES = {"m15": 15, "m30": 30, "h1": 60, "h4": 240}
# Column names of the two vintages of exchange files.
OLD_VINTAGE = {"SYMBOL": "symbol", "ISIN": "isin", "SERIES": "series", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "LAST": "last", "PREVCLOSE": "prevclose", "TOTTRDQTY": "volume", "TOTTRDVAL": "value", "TOTALTRADES": "trades", "TIMESTAMP": "date"}
NEW_VINTAGE = {"TckrSymb": "symbol", "ISIN": "isin", "SctySrs": "series", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close", "LastPric": "last", "PrvsClsgPric": "prevclose", "TtlTradgVol": "volume", "TtlTrfVal": "value", "TtlNbOfTxsExctd": "trades", "TradDt": "date"}
_NUMBERS = ["open", "high", "low", "close", "last", "prevclose", "volume", "value", "trades"]


def mixed_timestamp(text: Column) -> Column:
    """ISO texts stay year first; others are day first. Unreadable texts give null."""
    t = F.trim(text)
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MMM-yyyy")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def find_file(spark: SparkSession, root: str, name: str) -> str:
    """Path of the first file of a name, in the order of paths, in any folder below root; raises if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"{name} is nowhere below {root}")
    return found


def _cell(*names: str) -> Column:
    """The cell of a line under the first of the names that its file's header has; null if none has."""
    at = lambda n: F.get("_cells", (F.array_position("_names", n) - 1).cast("int"))
    return F.coalesce(*[F.when(F.array_contains("_names", n), at(n)) for n in names])


def _with_cells(lines: DataFrame, *, lower: bool) -> DataFrame:
    """lines (_file, _header, _line) with the cells of each line and the names of its own file's header."""
    parts = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    return lines.withColumn("_cells", parts(F.col("_line"))).withColumn("_names", parts(F.lower("_header") if lower else F.col("_header")))


def read_bars(spark: SparkSession, path: str, *, coerce: bool = False, divide_prices: float = 1.0, divided: tuple[str, ...] | None = None, keep_row: bool = False) -> DataFrame:
    """symbol, timeframe, date, open, high, low, close, volume of bar files in any of three dialects.

    Every file's own header decides for its lines, so a folder may mix dialects: a "Price," header
    names the day so and is followed by two lines of junk, tick_volume is the volume, others carry
    plain names in any case. coerce keeps rows whose values can't be read, as nulls; otherwise rows
    without a price are dropped. divide_prices applies to the symbols of divided, or to all.
    keep_row adds the position in the file, for checks of order. A folder without lines raises.
    """
    meta = "_metadata.file_path as _file", "_metadata.file_name as _name", "_metadata.file_block_start as _block"
    lines = spark.read.text(path).selectExpr("value as _line", *meta).withColumn("_at", F.monotonically_increasing_id())
    # a file's first line is the first one of the block that starts it: one row per file
    heads = lines.where("_block = 0").groupBy("_file").agg(F.min_by("_line", "_at").alias("_header"))
    if heads.isEmpty():
        raise ValueError(f"no lines in {path}")
    if keep_row:
        lines = lines.withColumn("row_id", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at")).cast("long"))
    raw = _with_cells(lines.join(heads, "_file"), lower=True)
    first = F.lower(F.get("_cells", F.lit(0)))
    raw = raw.where(~F.coalesce(first.isin("price", "date", "ticker", "datetime"), F.lit(False)) & (F.trim("_line") != ""))
    stem = r"(m15|m30|h1|h4|d1)?\.csv$"
    symbol = F.regexp_replace("_name", stem, "")
    number = lambda c: _cell(c).try_cast("double")
    by = F.lit(divide_prices) if divided is None else F.when(symbol.isin(*divided), F.lit(divide_prices)).otherwise(1.0)
    prices = [(number(c) / by).alias(c) for c in ("open", "high", "low", "close")]
    out = raw.select(
        symbol.alias("symbol"), F.nullif(F.regexp_extract("_name", stem, 1), F.lit("")).alias("timeframe"), mixed_timestamp(_cell("date", "datetime", "price")).alias("date"),
        *prices, F.coalesce(number("volume"), number("tick_volume")).alias("volume"), *(["row_id"] if keep_row else []),
    )
    return out if coerce else out.where("date is not null").dropna(subset=["open", "high", "low", "close"])


def read_exchange_archives(spark: SparkSession, path: str, *, session: str | None = None) -> DataFrame:
    """Rows of zipped exchange files of either vintage: EQ series only, one schema, absent columns null.

    Python only unpacks; which header names a column decides everything else on the JVM. A file
    whose dates are not all one session raises, with session (a pattern whose first group is a
    yyyyMMdd in the file's path) also one of another session than its name says.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                archive = zipfile.ZipFile(io.BytesIO(blob))
                with archive, archive.open(archive.infolist()[0]) as member:
                    header, *lines = io.TextIOWrapper(member, encoding="latin-1").read().splitlines() or [""]
                yield pd.DataFrame({"_line": lines}).assign(_file=name, _header=header)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = _with_cells(files.mapInPandas(unpack, "_line string, _file string, _header string").where("trim(_line) != ''"), lower=False)
    vintages = {column: [n for v in (OLD_VINTAGE, NEW_VINTAGE) for n, c in v.items() if c == column] for column in OLD_VINTAGE.values()}
    day = _cell(*vintages["date"])
    when = F.coalesce(*[F.to_date(F.try_to_timestamp(F.initcap(day), F.lit(form))) for form in ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy", "dd-MMM-yy")])
    new = F.array_contains("_names", "TckrSymb")
    out = raw.where(F.coalesce(_cell("FinInstrmTp") == "STK", F.lit(True)) & (_cell(*vintages["series"]) == "EQ"))
    out = out.select(
        when.alias("date"), *[_cell(*vintages[c]).alias(c) for c in ("symbol", "isin", "series")],
        *[_cell(*vintages[c]).try_cast("double").alias(c) for c in _NUMBERS], F.when(new, "new").otherwise("old").alias("source"), "_file",
    )
    own = Window.partitionBy("_file")
    one = F.coalesce(F.min("date").over(own) == F.max("date").over(own), F.lit(True))
    if session:
        one &= F.coalesce(F.col("date") == F.to_date(F.regexp_extract("_file", session, 1), "yyyyMMdd"), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("dates do not name the file's session: "), F.col("_file"))).cast("boolean")
    return out.withColumn("_one", one).where(F.when(F.col("_one"), F.lit(True)).otherwise(wrong)).drop("_file", "_one")


def panel_of(rows: DataFrame, *, new_from: str, specials: bool = False) -> DataFrame:
    """Exchange rows of all files as one panel: the new vintage from a day on, the old one before it.

    Weekend sessions are special: left out, or kept with specials; session_type says which a row
    is. Of several rows of a symbol and day the greatest counts.
    """
    x = rows.where((F.col("source") == "new") == (F.col("date") >= F.lit(new_from).cast("date")))
    x = x.withColumn("session_type", F.when(F.weekday("date") >= 5, "SPECIAL").otherwise("STANDARD"))
    x = x if specials else x.where("session_type = 'STANDARD'")
    rest = [c for c in x.columns if c not in ("symbol", "date")]
    return x.groupBy("symbol", "date").agg(F.max(F.struct(*rest)).alias("_row")).select("symbol", "date", "_row.*")


def official_closes(wanted: DataFrame, stored: DataFrame, later: DataFrame) -> DataFrame:
    """wanted (symbol, date) with close: the stored history, then later files; a day that neither has raises."""
    both = stored.select("symbol", "date", "close", F.lit(1).alias("_p")).unionByName(later.select("symbol", "date", "close", F.lit(0).alias("_p")))
    best = both.where("close is not null").groupBy("symbol", "date").agg(F.max_by("close", "_p").alias("close"))
    x = wanted.join(best, ["symbol", "date"], "left")
    return x.withColumn("close", F.coalesce("close", F.raise_error(F.lit("no official close of a wanted day")).cast("double")))


def read_corporate_actions(spark: SparkSession, path: str, *, cutoff: str | None = None) -> DataFrame:
    """symbol, isin, subject, ex_date, kind, factor of JSON files that hold a list or {"data": list}.

    EQ series only; rows without a readable ex-date are left out; one row per symbol, day and subject.
    """
    item = "struct<symbol:string,isin:string,series:string,subject:string,exDate:string>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.coalesce(F.from_json("value", f"array<{item}>"), F.from_json("value", f"struct<data:array<{item}>>")["data"])).alias("x")).select("x.*").where("series = 'EQ'")
    kind, factor = subject_kind_factor(F.col("subject"))
    out = rows.select("symbol", "isin", "subject", F.to_date(F.try_to_timestamp("exDate", F.lit("dd-MMM-yyyy"))).alias("ex_date"), kind.alias("kind"), factor.alias("factor")).where("ex_date is not null")
    if cutoff:
        out = out.where(F.col("ex_date") <= F.lit(cutoff).cast("date"))
    return out.groupBy("symbol", "ex_date", "subject").agg(F.max("isin").alias("isin"), F.first("kind").alias("kind"), F.first("factor").alias("factor"))


def read_list(spark: SparkSession, path: str, columns: list[str], *, encoding: str = "ISO-8859-1", day: str | None = None, form: str = "dd-MMM-yyyy", cutoff: str | None = None) -> DataFrame:
    """A headerless CSV list, trimmed; with day that column is a date, and rows after the cutoff or without one are left out."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, encoding=encoding)
    out = raw.select(*[F.trim(c).alias(c) for c in columns])
    if day:
        out = out.withColumn(day, F.to_date(F.try_to_timestamp(F.initcap(day), F.lit(form)))).where(F.col(day).isNotNull())
        out = out.where(F.col(day) <= F.lit(cutoff).cast("date")) if cutoff else out
    return out


def read_manifest(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Successful entries of some kinds of a JSON-lines manifest."""
    return spark.read.schema("path string, kind string, status int, sha256 string, session string").json(path).where(F.col("kind").isin(kinds) & (F.col("status") == 200))
