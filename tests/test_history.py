from datetime import date

from pyspark.sql import functions as F

from marketloom.operators.history import identifier_history, isin_change, merge_history

D = date
RES = "res_id long, symbol string, historical_symbol string, entity_id string, ex_date date, recorded_on date, attribute int, value int"
FLAG = "flag_id long, segment_id string, detail string, flagged_on date, entity_id string"
SEG = "segment_id string, entity_id string, value string"


def test_details_in_all_wordings(spark):
    a, b = "ZZE0001AB012", "ZZE0002CD019"
    texts = [
        f"{a}->{b} at 2021-01-29", f"new {b} replaces {a} wef 12-May-2021", f"{a}→{b} at 20200704", f"{a} -> {b} at 21-SEP-2022", f"at 2023-10-30: {a}->{b}",
        f"{a} => {b} effective 2 April 2021", f"ISIN changed from {a} to {b.lower()} on 1 May 2023", f"RORABADEKO50 -> RAKIMEHAFE50 2023-07-02  {a} != {b}",
        f"X&Y => Z (08-Sep-2022) {a} <> {b}", "PAVONOLIKE50|ZZE148GLV013|1", "", None, f"{a}->{b} at 2021-02-30",
    ]
    old, new, day = isin_change(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", old, new, day).sort("i").collect()]
    days = ["2021-01-29", "2021-05-12", "2020-07-04", "2022-09-21", "2023-10-30", "2021-04-02", "2023-05-01", "2023-07-02", "2022-09-08"]
    assert [(r[1], r[2], str(r[3])) for r in got[:9]] == [(a, b, d) for d in days]
    assert got[9][1] is None and got[10][1] is None and got[11][1] is None and got[12][3] is None


def test_symbol_and_isin_versions(spark):
    res = [
        (1, "new", "old", "E", D(2020, 1, 1), D(2020, 6, 1), 0, 0),
        (2, " NEW\t", "Old", "E", D(2020, 3, 1), D(2020, 7, 1), 0, 0),
        (3, "OTHER", "MID", "E", D(2020, 3, 1), D(2020, 6, 1), 0, 0),  # an earlier recording loses both its days
        (3, "OTHER", "MID", "E", D(2020, 3, 1), D(2020, 6, 1), 0, 0),
        (4, "X", "Y", None, D(2020, 1, 1), D(2020, 2, 1), 0, 0),
        (5, None, "", "F", D(2020, 1, 1), D(2020, 2, 1), 0, 0),
    ]
    flags = [
        (1, " S1 ", "ZZE0001AB012->ZZE0002CD019 at 2021-01-10", D(2021, 1, 12), "no"),
        (2, "S1", "ZZE0001AB012->ZZE0002CD019 at 2021-01-11", D(2021, 1, 13), "no"),  # reported again
        (3, "S1", "ZZE0002CD019->ZZE0003EF016 at 2022-01-10", D(2022, 1, 12), "no"),
        (4, "GONE", "ZZE0002CD019->ZZE0003EF016 at 2022-01-10", D(2022, 1, 12), "no"),
        (5, None, None, None, None),
    ]
    seg = [("S1", "E", "clash"), ("S2", None, "clash")]
    got = identifier_history(spark.createDataFrame(res, RES), spark.createDataFrame(flags, FLAG), spark.createDataFrame(seg, SEG))
    rows = sorted((r["attribute"], r["entity_id"], r["value"], str(r["valid_from"]), str(r["valid_to"])) for r in got.collect())
    assert rows == [
        ("isin", "E", "ZZE0001AB012", "0001-01-01", "2021-01-11"),
        ("isin", "E", "ZZE0002CD019", "2021-01-11", "2022-01-10"),
        ("isin", "E", "ZZE0003EF016", "2022-01-10", "9999-12-31"),
        ("symbol", "E", "NEW", "2020-07-01", "9999-12-31"),
        ("symbol", "E", "OLD", "2020-01-01", "2020-06-01"),
        ("symbol", "E", "OTHER", "2020-06-01", "2020-07-01"),
    ]


def test_merge_closes_and_opens(spark):
    def merge(dim, rows):
        df = spark.createDataFrame(rows, "k string, v string, w int, day date, seq int")
        return merge_history(dim, df, key=("k",), attributes=("v", "w"), day="day", precedence=F.col("seq"))

    first = merge(None, [("a", "x", 1, D(2020, 1, 1), 0), ("b", "x", 1, D(2020, 1, 1), 0), ("a", "x", 1, D(2020, 1, 5), 0), (None, "q", 1, D(2020, 1, 1), 0), ("a", "y", None, None, 0)])
    second = merge(first, [("a", "x", 1, D(2020, 2, 1), 0), ("a", None, None, D(2020, 3, 1), 0), ("a", "z", 3, D(2020, 3, 1), 1), ("c", None, None, D(2020, 3, 1), 0)])
    got = sorted((r["k"], r["v"] or "", str(r["valid_from"]), str(r["valid_to"])) for r in second.collect())
    assert got == [("a", "x", "2020-01-01", "2020-03-01"), ("a", "z", "2020-03-01", "9999-12-31"), ("b", "x", "2020-01-01", "9999-12-31"), ("c", "", "2020-03-01", "9999-12-31")]
    assert merge(None, []).collect() == []


def test_late_batches_in_any_order_equal_one_batch(spark):
    import random

    rng = random.Random(3)

    def merge(dim, rows):
        df = spark.createDataFrame(rows, "k string, v string, day date, seq int")
        return merge_history(dim, df, key=("k",), attributes=("v",), day="day", precedence=F.col("seq"))

    late = merge(merge(None, [("a", "A", D(2020, 1, 1), 0), ("a", "A", D(2020, 1, 5), 1)]), [("a", "B", D(2020, 1, 3), 2)])
    assert sorted((r["v"], r["valid_from"].day, r["valid_to"].year) for r in late.collect()) == [("A", 1, 2020), ("A", 5, 9999), ("B", 3, 2020)]
    rows = [(rng.choice("aab"), rng.choice(["x", "y", None]), D(2020, 1, rng.randrange(1, 28)), i) for i in range(60)]
    whole = sorted(merge(None, rows).select("k", "v", "valid_from", "valid_to").collect(), key=str)
    rng.shuffle(rows)
    dim = None
    for i in range(0, 60, 20):
        dim = merge(dim, rows[i : i + 20])
    assert sorted(dim.select("k", "v", "valid_from", "valid_to").collect(), key=str) == whole
