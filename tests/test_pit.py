import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from marketloom.operators.pit import attributes_as_known, periods_in_force

D = date(2020, 1, 1)
EV = "order_id long, entity string, s_plus date, univ_id string, _day int"  # the last two clash and are ignored
AT = "univ_id long, entity_id string, selection_date date, recorded_on date, order_id string, _best int"
PE = "rate_id long, component string, from date, to date, known_on date, order_id long"


def rank(spark, events, rows):
    df = attributes_as_known(
        spark.createDataFrame(events, EV), spark.createDataFrame(rows, AT), event_id="order_id", event_entity="entity", event_day="s_plus",
        entity="entity_id", valid_from="selection_date", known_from="recorded_on", row_id="univ_id",
    )
    return sorted(tuple(r) for r in df.collect())


def rates(spark, events, rows):
    df = periods_in_force(
        spark.createDataFrame(events, EV), spark.createDataFrame(rows, PE), event_id="order_id", event_day="s_plus",
        component="component", start="from", end="to", known_from="known_on", row_id="rate_id",
    )
    return sorted(tuple(r) for r in df.collect())


def brute_rank(events, rows):
    out = set()
    for o, e, s, *_ in events:
        if e is None or s is None or not e.strip():
            continue
        fit = [(v, k, u) for u, n, v, k, *_ in rows if n is not None and v is not None and k is not None and n.strip() == e.strip() and v <= s and k <= s]
        if fit:
            out.add((o, max(fit)[2]))
    return sorted(out)


def test_late_corrections_ties_and_copies(spark):
    rows = [
        (1, "A", D, D, "x", 0),
        (2, "A", D + timedelta(30), D + timedelta(60), "x", 0),  # recorded late
        (3, "A", D, D + timedelta(10), "x", 0),  # restated
        (4, "A", D, D + timedelta(10), "x", 0),  # same days, greater id
        (4, "A", D, D + timedelta(10), "x", 0),
        (5, None, D, D, "x", 0),
        (6, "A", None, D, "x", 0),
    ]
    events = [(10, " A\t", D, "u", 1), (11, "A", D + timedelta(9), "u", 1), (12, "A", D + timedelta(10), "u", 1), (13, "A", D + timedelta(59), "u", 1),
              (14, "A", D + timedelta(60), "u", 1), (15, "A", None, "u", 1), (16, None, D, "u", 1), (17, "B", D, "u", 1), (18, "A", D - timedelta(1), "u", 1), (10, " A\t", D, "u", 1)]
    assert rank(spark, events, rows) == [(10, 1), (11, 1), (12, 4), (13, 4), (14, 2)]


def test_against_brute_force_with_a_hot_entity(spark):
    rng = random.Random(5)
    key = lambda: "HOT" if rng.random() < 0.4 else f"E{rng.randrange(6)}"
    rows = [(i, key(), D + timedelta(rng.randrange(60)), D + timedelta(rng.randrange(90)), "x", 0) for i in range(300)]
    events = [(i, key(), D + timedelta(rng.randrange(100)), "u", 1) for i in range(500)]
    assert rank(spark, events, rows) == brute_rank(events, rows)


def test_empty_tables(spark):
    assert rank(spark, [], []) == [] and rates(spark, [], []) == []
    assert rank(spark, [(1, "A", D, "u", 1)], []) == [] and rates(spark, [(1, "A", D, "u", 1)], []) == []


def test_periods_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        a = D + timedelta(rng.randrange(80))
        rows.append((i, rng.choice("xyz"), a, None if rng.random() < 0.2 else a + timedelta(rng.randrange(-2, 40)), D + timedelta(rng.randrange(90)), 1))
    rows.append((99, "x", None, None, D, 1))
    events = [(i, None, D + timedelta(rng.randrange(120)), "u", 1) for i in range(80)] + [(500, "A", None, "u", 1)]
    want = set()
    for o, _, s, *_ in events:
        for c in "xyz":
            fit = [(k, r) for r, comp, a, b, k, _ in rows if comp == c and s and a and a <= s and (b is None or s <= b) and k <= s]
            if fit:
                want.add((o, c, max(fit)[1]))
    assert rates(spark, events, rows) == sorted(want)


def test_wide_columns_follow(spark):
    rows = spark.createDataFrame([(1, "A", D, D, "x", 7)], AT)
    ev = spark.createDataFrame([(10, "A", D, "u", 1)], EV)
    df = attributes_as_known(ev, rows, event_id="order_id", event_entity="entity", event_day="s_plus", entity="entity_id", valid_from="selection_date", known_from="recorded_on", row_id="univ_id", keep=("_best",))
    assert df.select("order_id", "univ_id", F.col("_best")).collect() == [(10, 1, 7)]


def test_a_day_of_the_last_century_costs_no_calendar(spark):
    far = date(9999, 12, 31)
    rows = [(1, "x", D, None, D, 1), (2, "x", D + timedelta(5), D + timedelta(9), D, 1), (3, "y", date(1, 1, 1), far, date(1, 1, 1), 1)]
    events = [(1, None, far, "u", 1), (2, None, D + timedelta(7), "u", 1), (3, None, date(1, 1, 1), "u", 1)]
    assert rates(spark, events, rows) == [(1, "x", 1), (1, "y", 3), (2, "x", 2), (2, "y", 3), (3, "y", 3)]
