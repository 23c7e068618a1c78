import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketloom.functions.subjects import subject_kind_factor
from marketloom.sources.readers import find_file, mixed_timestamp, official_closes, panel_of, read_bars, read_corporate_actions, read_exchange_archives, read_list, read_manifest
from marketloom.sources.writers import append_log, snapshot_raw, write_bars_csv, write_once, write_or_verify


def test_three_dialects(spark, tmp_path):
    a, b, c = tmp_path / "A", tmp_path / "B", tmp_path / "C"
    for d in (a, b, c):
        d.mkdir()
    (a / "NIFTYd1.csv").write_text("Price,Close,High,Low,Open,Volume\nTicker,X,X,X,X,X\nDate,,,,,\n2020-01-02,10,11,9,9.5,100\n2020-01-03,,11,9,9.5,100\n")
    (b / "GOLDm15.csv").write_text("Date,open,high,low,close,tick_volume\n05-01-2012 08:15,17200,17300,17100,17250,7\n")
    (c / "X.csv").write_text("Date,Open,High,Low,Close,Volume\n2012-11-14,1,2,0.5,1.5,\nbad,1,2,0.5,1.5,3\n")
    assert [tuple(r) for r in read_bars(spark, str(a)).collect()] == [("NIFTY", "d1", datetime(2020, 1, 2), 9.5, 11.0, 9.0, 10.0, 100.0)]
    assert read_bars(spark, str(b), divide_prices=100.0).select("symbol", "timeframe", "date", "close").first() == ("GOLD", "m15", datetime(2012, 1, 5, 8, 15), 172.5)
    assert read_bars(spark, str(c)).count() == 1 and read_bars(spark, str(c), coerce=True, keep_row=True).count() == 2


def test_mixed_timestamp(spark):
    x = spark.createDataFrame([("05-01-2012",), ("2012-11-14",), ("x",), (None,)], "t string").select(mixed_timestamp(F.col("t")))
    assert [r[0] for r in x.collect()] == [datetime(2012, 1, 5), datetime(2012, 11, 14), None, None]


def test_exchange_archives(spark, tmp_path):
    old = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP\nAAA ,EQ,1,2,1,2,2,1,10,20,24-AUG-2004\nBBB,BE,1,2,1,2,2,1,10,20,24-AUG-2004\n"
    new = "TradDt,FinInstrmTp,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\n2024-01-02,STK,INE1,AAA,EQ,1,2,1,x,2,1,10,20,3\n2024-01-02,IDX,INE1,IDX,EQ,1,2,1,2,2,1,10,20,3\n"
    for name, text in (("a.zip", old), ("b.zip", new)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("f.csv", text)
    got = sorted((r["date"], r["symbol"], r["isin"], r["close"], r["source"]) for r in read_exchange_archives(spark, str(tmp_path)).collect())
    assert got == [(date(2004, 8, 24), "AAA", None, 2.0, "old"), (date(2024, 1, 2), "AAA", "INE1", None, "new")]


def test_corporate_actions_and_lists(spark, tmp_path):
    rec = {"symbol": "A", "isin": "I", "series": "EQ", "subject": "Bonus 1:1", "exDate": "02-Jan-2020"}
    d = tmp_path / "ca"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([rec, rec | {"series": "BE"}, rec | {"exDate": "-"}]))
    (d / "b.json").write_text(json.dumps({"data": [rec, rec | {"subject": "Rights 1:2", "exDate": "02-Jan-2030"}]}))
    got = read_corporate_actions(spark, str(d), cutoff="2025-01-01").collect()
    assert [(r["symbol"], r["ex_date"], r["kind"], r["factor"]) for r in got] == [("A", date(2020, 1, 2), "BONUS", 0.5)]
    (tmp_path / "l.csv").write_bytes("Ã  , b\n".encode("latin-1"))
    assert read_list(spark, str(tmp_path / "l.csv"), ["x", "y"]).collect() == [("Ã", "b")]
    (tmp_path / "m.jsonl").write_text('{"path":"p","kind":"k","status":200}\n{"path":"q","kind":"k","status":404}\n')
    assert read_manifest(spark, str(tmp_path / "m.jsonl"), ["k"]).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", datetime(2020, 1, 2), 1.0, 2.0, 0.5, 1.5, 7), ("B", datetime(2021, 1, 2), 1.0, 2.0, 0.5, 1.5, 7)], "symbol string, date timestamp, open double, high double, low double, close double, volume long")
    write_once(df, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).where("year = 2020").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        write_once(df, str(tmp_path / "w"))
    assert write_or_verify(df, str(tmp_path / "v")) is True and write_or_verify(df.sort(F.desc("symbol")), str(tmp_path / "v")) is False
    with pytest.raises(ValueError):
        write_or_verify(df.limit(1), str(tmp_path / "v"))
    for _ in range(2):
        write_bars_csv(df, str(tmp_path / "c"))
    assert (tmp_path / "c" / "symbol=A").exists() and (tmp_path / "c.backup").exists()
    append_log(df, str(tmp_path / "log"))
    append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_a_folder_of_mixed_dialects(spark, tmp_path):
    sub = tmp_path / "in" / "deep"
    sub.mkdir(parents=True)
    (sub / "Ad1.csv").write_text("Price,Close,High,Low,Open,Volume\nTicker,X,X,X,X,X\nDate,,,,,\n2020-01-02,10,11,9,9.5,100\n")
    (sub / "Bd1.csv").write_text("date,open,high,low,close,volume\n2020-01-02,9.5,11,9,10,100\n2020-01-01,9.5,11,9,10,100\n")
    (sub / "XAUUSDm15.csv").write_text("Date,Open,High,Low,Close,tick_volume\n05-01-2012 08:15,17200,17300,17100,17250,7\n")
    got = {(r["symbol"], r["row_id"]): (r["open"], r["close"], r["volume"]) for r in read_bars(spark, str(sub), divide_prices=100.0, divided=("XAUUSD",), keep_row=True).collect()}
    assert got == {("A", 4): (9.5, 10.0, 100.0), ("B", 2): (9.5, 10.0, 100.0), ("B", 3): (9.5, 10.0, 100.0), ("XAUUSD", 2): (172.0, 172.5, 7.0)}
    assert find_file(spark, str(tmp_path), "Bd1.csv").endswith("deep/Bd1.csv")
    with pytest.raises(FileNotFoundError):
        find_file(spark, str(tmp_path), "none.csv")


def test_sessions_of_archives_and_panels(spark, tmp_path):
    text = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP\nAAA,EQ,1,2,1,2,2,1,10,20,{}\nBBB,EQ,1,2,1,3,2,1,10,20,{}\n"
    for name, a, b in (("f20040824.zip", "24-AUG-2004", "24-AUG-2004"), ("g20040828.zip", "28-AUG-2004", "28-AUG-2004"), ("h20240103.zip", "03-JAN-2024", "03-JAN-2024")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.csv", text.format(a, b))
    pattern = r"[a-z](\d{8})\.zip"
    rows = read_exchange_archives(spark, str(tmp_path), session=pattern)
    assert rows.count() == 6
    assert sorted((r["symbol"], r["date"].day) for r in panel_of(rows, new_from="2024-01-01").collect()) == [("AAA", 24), ("BBB", 24)]
    assert panel_of(rows, new_from="2024-01-01", specials=True).where("session_type = 'SPECIAL'").count() == 2
    wanted = rows.where("symbol = 'BBB'").select("symbol", "date").limit(1)
    assert official_closes(wanted, rows.withColumn("close", F.lit(9.0)), rows).first()["close"] == 9.0
    with pytest.raises(Exception, match="official close"):
        official_closes(wanted.withColumn("symbol", F.lit("?")), rows, rows).collect()
    with zipfile.ZipFile(tmp_path / "i20240104.zip", "w") as z:
        z.writestr("x.csv", text.format("03-JAN-2024", "03-JAN-2024"))
    with pytest.raises(Exception, match="session"):
        read_exchange_archives(spark, str(tmp_path), session=pattern).collect()
    (tmp_path / "l.csv").write_text("A,02-JAN-2020\nB,03-JAN-2021\nC,-\n")
    assert [r["s"] for r in read_list(spark, str(tmp_path / "l.csv"), ["s", "d"], day="d", cutoff="2020-12-31").collect()] == ["A"]
    snapshot_raw(rows, str(tmp_path / "snap"), str(tmp_path / "m"), kind="k")
    assert spark.read.json(str(tmp_path / "m")).first()["rows"] == 6
    with pytest.raises(Exception, match="(?i)exist"):
        snapshot_raw(rows, str(tmp_path / "snap"), str(tmp_path / "m"), kind="k")


def test_subject_grammar(spark):
    cases = [
        ("BONUS ISSUE  2:3", "BONUS", 0.6), ("bon shares in the ratio of 1:4", "BONUS", 0.8), ("Stock Split from Rs. 5/- to Re 1/-", "SPLIT", 0.2), ("FV spl - Rs 10 to Rs 2", "SPLIT", 0.2),
        ("Sub-Division of shares Rs.10 to Rs.5", "SPLIT", 0.5), ("Split Rs 2 to Rs 10", "UNPARSED_BONUS_SPLIT", None), ("Int div 20% + spl 10%", "DIVIDEND", None), ("Spl. dividend Rs 10 to holders 2", "DIVIDEND", None),
        ("Bonus 1:1 and split Rs 10 to Rs 5", "BONUS+SPLIT", 0.25), ("Consolidation Re 1 to Rs 10", "CONSOLIDATION", None), ("Bonus of preference shares 1:1", "NON_EQUITY_BONUS", None), ("Bonus", "UNPARSED_BONUS_SPLIT", None),
        ("Rights 1:5", "RIGHTS", None), ("", "OTHER", None), (None, "OTHER", None), ("EGM", "OTHER", None),
    ]
    kind, factor = subject_kind_factor(F.col("s"))
    got = [tuple(r) for r in spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string").select("i", kind.alias("k"), factor.alias("f")).sort("i").collect()]
    assert [(k, None if f is None else round(f, 6)) for _, k, f in got] == [(k, f) for _, k, f in cases]
