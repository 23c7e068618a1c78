"""The ladder's holdings against a loop over the same rows, and small worlds worked out by hand."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import costs as C
from marketloom.operators import ladder as L

PANEL = "entity int, date date, r_naive double, r_rg double, r_raw double, cls string, raw_ok boolean, gap_free boolean"


def world(seed=4):
    rng = random.Random(seed)
    days = [d for i in range(300) if (d := date(2012, 1, 2) + timedelta(i)).weekday() < 5]
    rows = {}
    for e in range(6):
        begun = False
        for d in days:
            gone = e == 4 and d > date(2012, 8, 20) or e == 1 and date(2012, 4, 20) < d < date(2012, 6, 12) or rng.random() < 0.08
            if gone:
                continue
            cls = "FIRST" if not begun else rng.choices(["OK", "BAD", "SPAN"], [8, 1, 1])[0]
            begun = True
            raw = None if cls == "FIRST" else rng.uniform(-0.05, 0.05)
            rows[e, d] = (None if raw is None else raw * 1.5, raw if cls == "OK" else None, raw, cls, bool(raw and raw > 0), False)
    return days, rows


@pytest.mark.parametrize("missing", ["FILL", "RAW", "ZERO"])
def test_holdings_against_a_loop(spark, missing):
    days, rows = world()
    panel = spark.createDataFrame([(e, d, *v) for (e, d), v in rows.items()], PANEL)
    months = L.calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    cal = {r["t"]: r for r in months.collect()}
    rng = random.Random(7)
    held = [(s, t, leg, e) for s in "ACD" for t in cal for leg in ("W", "L") for e in rng.sample(range(6), 3)]
    got = {(r["step"], r["t"], r["leg"], r["entity"]): r for r in L.holdings(spark.createDataFrame(held, "step string, t date, leg string, entity int"), panel, months, missing=missing).collect()}
    want, consumed = {}, {}
    for t in sorted(cal):
        a, b = cal[t]["s_plus"], cal[t]["s_pp"]
        if a is None or b is None:
            continue
        for s in "ACD":
            for leg in ("W", "L"):
                names, used = [e for x, y, z, e in held if (x, y, z) == (s, t, leg)], consumed.setdefault((s, leg), set())
                value = dict.fromkeys(names, 1.0)
                for d in (d for d in days if a < d <= b):
                    ok = [rows[e, d][1] for e in names if (e, d) in rows and rows[e, d][3] == "OK" and (e, d) not in used]
                    for e in names:
                        if (e, d) not in rows or (e, d) in used:
                            continue
                        naive, rg, raw, cls, *_ = rows[e, d]
                        if s != "D":
                            value[e] *= 1 + (0 if cls == "FIRST" else naive)
                        elif cls == "OK":
                            value[e] *= 1 + rg
                        elif cls != "SPAN":
                            value[e] *= 1 + {"FILL": sum(ok) / len(ok) if ok else 0, "RAW": raw or 0, "ZERO": 0}[missing]
                for e in names if s != "A" else []:
                    if (e, b) not in rows:
                        back = [d for d in days if d > b and (e, d) in rows]
                        value[e] *= 0.7 if not back else 1 + (rows[e, back[0]][2 if s == "D" else 0] or 0)
                        used |= {(e, back[0])} if back else set()
                want |= {(s, t, leg, e): v for e, v in value.items()}
    assert set(got) == set(want) and all(got[k]["value"] == pytest.approx(v) for k, v in want.items())
    assert any(r["gone"] for r in got.values()) and any(r["booked"] for r in got.values())


def test_calendar_universes_and_legs(spark):
    days = [date(2012, m, d) for m in range(1, 13) for d in (3, 10, 28) if m != 7] + [date(2013, 1, 2), date(2013, 2, 4)]
    cal = {r["t"]: r for r in L.calendar(spark.createDataFrame([(d,) for d in days], "date date"), primary_until=F.lit(date(2012, 6, 30))).collect()}
    first, june, last = cal[date(2012, 1, 28)], cal[date(2012, 6, 28)], cal[date(2013, 1, 2)]
    assert (first["m12"], first["m1"], first["s_plus"], first["s_pp"], first["sample"]) == (None, None, date(2012, 2, 3), date(2012, 3, 3), "PRIMARY")
    assert june["s_plus"] == date(2012, 8, 3) and june["s_pp"] is None and last["m12"] == date(2012, 1, 28) and last["sample"] == "OOS"
    ranked = spark.createDataFrame([(t, e, e) for t in (1, 2) for e in range(1, 6 - t)], "t int, entity int, place int")
    got = {}
    for r in L.universes(ranked, F.col("entity") != 1, size=2, fixed_on=F.lit(1)).collect():
        got.setdefault((r["universe"], r["t"]), set()).add(r["entity"])
    assert got == {("A", 1): {2, 3}, ("A", 2): {2, 3}, ("B", 1): {2, 3}, ("B", 2): {2, 3}, ("C", 1): {1, 2}, ("C", 2): {1, 2}}
    scores = spark.createDataFrame([("A", 1, e, s) for e, s in ((1, 0.5), (2, 0.5), (3, 0.1), (4, -1.0))], "step string, t int, entity int, score double")
    assert sorted((r["leg"], r["entity"]) for r in L.legs(scores).collect()) == [("BM", 1), ("BM", 2), ("BM", 3), ("BM", 4), ("L", 4), ("W", 1)]


def test_costs_of_orders(spark):
    orders = spark.createDataFrame([("D", 1, "W", 1, date(1998, 3, 2), 0.01, 3), ("D", 1, "W", 2, date(1998, 3, 2), -0.02, None), ("D", 1, "W", 3, date(1998, 3, 2), 0.03, 11)], "step string, t int, leg string, entity int, s_plus date, weight_change double, place int")
    rows = {r["entity"]: r for r in C.order_costs(orders, C.schedule(spark)).collect()}
    base = 100_000 * 0.0000345 + 100_000 * 0.000001 + 20.0
    assert rows[1]["total_cost_rs"] == pytest.approx(100_000 * 0.00125 + 100_000 * 0.00015 + base * 1.18) and rows[1]["slippage_S2_rs"] == pytest.approx(100.0)
    assert rows[2]["dp_charge_rs"] == 15.34 and rows[2]["stamp_duty_rs"] == 0.0 and (rows[2]["slippage_band"], rows[2]["band_fallback"]) == (C.LOW, True) and rows[3]["band_fallback"]
    m = C.monthly_costs(C.order_costs(orders, C.schedule(spark))).first()
    assert (m["n_orders"], m["n_sold"], m["n_fallback"]) == (3, 1, 2) and m["traded_fraction"] == pytest.approx(0.06)
    with pytest.raises(Exception, match="exactly one period"):
        C.order_costs(orders.withColumn("s_plus", F.lit(date(1980, 1, 1))), C.schedule(spark)).collect()
