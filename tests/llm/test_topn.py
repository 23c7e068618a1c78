import random
from datetime import date

from marketloom.llm.topn import admissible_ranks, best_per_group


def best(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "g string, score double, item string, _bin int, place int")
    return sorted((r["g"], r["place"], r["item"]) for r in best_per_group(df, ["g"], "score", ["item"], n, **kw).collect())


def brute(rows, n):
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted((s, i) for a, s, i, *_ in rows if a == g and s is not None and s == s)
        out += [(g, k, i) for k, (_, i) in enumerate(own[:n], 1)]
    return sorted(out)


def test_ties_and_hot_groups(spark):
    rng = random.Random(3)
    rows = [("HOT" if rng.random() < 0.5 else f"g{rng.randrange(9)}", float(rng.randrange(12)), f"i{k:05d}", 0, 0) for k in range(2000)]
    rows += [("same", 1.0, f"i{k:05d}", 0, 0) for k in range(500)] + [("few", 2.0, "a", 0, 0), ("bad", None, "a", 0, 0), ("bad", float("nan"), "b", 0, 0), (None, 1.0, "c", 0, 0), ("neg", -1.0, "c", 0, 0)]
    for n in (1, 5):
        assert best(spark, rows, n) == brute(rows, n)
    assert best(spark, rows, 5, salts=1, bins_per_octave=1) == brute(rows, 5)


def test_empty(spark):
    assert best(spark, [], 5) == []


def test_admissible(spark):
    d = date(2020, 1, 31)
    rows = [
        ("P", d, "A", d, 1, "MEMBER", 1.0), ("P", d, "A", date(2020, 2, 3), 2, "EXCLUDED", 1.0),
        ("P", d, "B", d, 3, " member ", 2.0), ("P", d, "B", d, 4, "Eligible_not_Selected", 3.0),
        ("P", d, "C", d, 5, "MEMBER", float("nan")), ("P", d, "D", d, 6, None, 1.0), ("P", d, "E", d, 7, "MEMBER", 0.0), ("P", d, None, d, 8, "MEMBER", 1.0), ("P", d, "F", d, 9, "MEMBER", None),
    ]
    df = spark.createDataFrame(rows + rows[:3], "pool string, selection_date date, entity_id string, recorded_on date, univ_id long, status string, rank double")
    assert [(r["entity_id"], r["rank"]) for r in admissible_ranks(df).collect()] == [("B", 3.0)]


def test_both_signs_and_directions_against_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([-1, 1]) * rng.choice([0.0, 0.5, 1.0, 3.5, 1e9, 1e300, float("inf"), rng.random() * 100]), i) for i in range(300)]
    df = spark.createDataFrame([*rows, ("a", float("nan"), 900), ("a", None, 901), (None, 1.0, 902)], "g string, s double, t int")
    for down in (False, True):
        got = sorted((r["g"], r["place"], r["s"], r["t"]) for r in best_per_group(df, ["g"], "s", ["t"], 7, descending=down, salts=3).collect())
        want = []
        for g in "ab":
            best = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1] if down else x[1], x[2]))[:7]
            want += [(g, i, s, t) for i, (_, s, t) in enumerate(best, 1)]
        assert got == want
