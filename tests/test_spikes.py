import math
import random
from datetime import date, timedelta

from marketloom.operators.spikes import SpikeRules, implausible_readings

SCHEMA = "residual_id long, entity_id string, date date, prev_close double, close double, ret_raw double, event_factor double, _scale string, _series int"
NAN = float("nan")


def series(entity, n, start_id=0, seed=1, sd=0.01, price=1000.0):
    rng, rows, d, i = random.Random(seed), [], date(2015, 1, 1), 0
    while len(rows) < n:
        if d.weekday() < 5:
            prev, price = price, round(price * math.exp(rng.gauss(0, sd)), 2)
            rows.append([start_id + i, entity, d, prev, price, round(price / prev - 1, 6), None, "x", 0])
            i += 1
        d += timedelta(1)
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return {r[0] for r in implausible_readings(df, **kw).collect()}


def put(rows, i, close, follow=True):
    rows[i][4] = close
    rows[i][5] = round(close / rows[i][3] - 1, 6)
    if follow:
        rows[i + 1][3] = close
        rows[i + 1][5] = round(rows[i + 1][4] / close - 1, 6)


def test_kinds_of_bad_readings(spark):
    r = series("A", 120)
    put(r, 20, r[20][4] * 1.3)  # and the next row repeats it
    put(r, 30, r[30][4] * 0.7, follow=False)
    r[40][4] = -5.0
    r[45][5] = r[45][5] + 0.5  # contradicts its prices
    r[50][3] = float("inf")
    for i in (60, 61, 62):  # wrong by a hundred for three days
        r[i][4] = r[i][4] * 100
        r[i + 1][3] = r[i][4]
    for i in (60, 61, 62, 63):
        r[i][5] = r[i][4] / r[i][3] - 1
    r[70][4] = NAN
    r[70][5] = None
    r[71][3] = None
    r[71][5] = NAN
    assert found(spark, r) == {20, 21, 30, 40, 45, 50, 60, 61, 62, 63}


def test_explained_moves_and_quiet_series(spark):
    r = series("A", 100)
    for i in range(50, 100):  # a split on row 50
        r[i][4] = round(r[i][4] / 2, 2)
        if i > 50:
            r[i][3] = r[i - 1][4]
        r[i][5] = r[i][4] / r[i][3] - 1
    r[50][6] = 0.5
    assert found(spark, r) == set()
    r[50][6] = None
    assert 50 in found(spark, r)
    flat = series("F", 40, sd=0.0)
    assert len(found(spark, flat)) == 0 or found(spark, flat) == set()


def test_stuck_runs(spark):
    r = series("A", 120)
    for i in range(40, 55):
        r[i][4] = r[39][4]
        r[i][3] = r[39][4]
        r[i][5] = 0.0
    r[55][3] = r[39][4]
    r[55][5] = r[55][4] / r[55][3] - 1
    got = found(spark, r)
    assert set(range(40, 55)) <= got and 39 not in got


def test_batch_size_does_not_change_the_result(spark):
    rows = []
    for k in range(4):
        r = series(f"E{k}", 900, start_id=k * 10_000, seed=k)
        for i in range(37, 880, 101):
            put(r, i, r[i][4] * (1.2 if i % 2 else 0.8))
        rows += r
    whole = found(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert found(spark, rows) == whole and len(whole) > 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_new_level_is_accepted(spark):
    r = series("A", 200)
    for i in range(100, 200):
        r[i][4] = r[i][4] * 3
        r[i][3] = r[i][3] * 3 if i > 100 else r[i][3]
        r[i][5] = r[i][4] / r[i][3] - 1
    assert found(spark, r) == {100}


def test_edges(spark):
    assert found(spark, []) == set()
    one = series("A", 1)
    assert found(spark, one + one) == set()
    lone = [[1, None, date(2020, 1, 1), 10.0, -1.0, None, None, "x", 0], [2, "B", None, 10.0, 10.5, 0.05, None, "x", 0], [3, None, None, None, None, None, None, "x", 0], [4, None, None, 10.0, 20.0, 3.0, None, "x", 0]]
    assert found(spark, lone) == {1, 4}


def test_state_carried_over_batches_equals_one_batch():
    import numpy as np
    import pandas as pd

    from marketloom.operators.spikes import judge

    rng = random.Random(11)
    rows = []
    for k, n in enumerate((3, 200, 14, 700, 16, 120)):
        part = series(f"E{k}", n, start_id=1000 * k, seed=k)
        for _ in range(n // 12):
            put(part, rng.randrange(max(1, n - 2)), part[0][4] * rng.choice([0.5, 1.4, 100.0]))
        if n > 100:
            for i in range(40, 40 + 12 + k):  # stuck
                part[i][4] = part[39][4]
            for i in range(60, n):  # a level that is confirmed
                part[i][3], part[i][4] = part[i][3] * 3, part[i][4] * 3
        rows += part
    frame = pd.DataFrame(
        {"residual_id": [r[0] for r in rows], "_series": [r[1] for r in rows], "_day": [(r[2] - date(1970, 1, 1)).days for r in rows], "prev_close": [r[3] for r in rows], "close": [r[4] for r in rows], "ret_raw": [r[5] for r in rows], "_factor": np.nan, "_scale": 0.01, "_usual": 1.0}
    )
    _, whole, _ = judge(frame, SpikeRules())
    assert 100 < whole.sum() < len(rows)
    for size in (1, 5, 13, 100, 333):
        ids, flags, carried = [], [], None
        for lo in range(0, len(frame), size):
            out, bad, carried = judge(frame.iloc[lo : lo + size], SpikeRules(), carried, more=True)
            ids += out["residual_id"].tolist()
            flags += bad.tolist()
        out, bad, _ = judge(frame.iloc[:0], SpikeRules(), carried)
        assert ids + out["residual_id"].tolist() == frame["residual_id"].tolist()
        assert flags + bad.tolist() == whole.tolist(), size
