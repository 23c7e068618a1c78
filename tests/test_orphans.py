import random
from datetime import date, timedelta

import pytest

from marketloom.operators.orphans import advance, replay, snapshot, snapshot_counts

D = date(2021, 1, 1)
REF = "space string, ref_key string, ref_table string, day date, cause int"
PAR = "space string, parent_id string, ref_key string, registered_on date, removed_on date, day int"


def brute(refs, parents):
    out = set()
    for space, key, t, day, _ in refs:
        if key is None or day is None:
            continue
        own = [(a, b) for s, _, k, a, b, _ in set(parents) if s == space and k == key]
        if any((a is None or a <= day) and (b is None or b > day) for a, b in own):
            continue
        cause = "MISSING" if not own else "DELETED" if any(a is None or a <= day for a, _ in own) else "LATE"
        out.add((t, day.strftime("%Y-%m"), key, cause))
    return sorted(out)


def world(seed):
    rng = random.Random(seed)
    day = lambda: D + timedelta(rng.randrange(300))
    key = lambda: "HOT" if rng.random() < 0.3 else f"K{rng.randrange(12)}"
    refs = [(rng.choice("se"), key(), rng.choice(["t1", "t2"]), day(), 0) for _ in range(300)] + [("s", None, "t1", D, 0), ("s", "K1", "t1", None, 0)]
    parents = []
    for i in range(20):
        a = day()
        parents.append((rng.choice("se"), f"p{i}", key(), a, None if rng.random() < 0.5 else a + timedelta(rng.randrange(1, 80)), 0))
    return refs + refs[:20], [*parents, *parents[:3], ("s", "p98", "K3", None, None, 0)]


@pytest.mark.parametrize("increments", [1, 3])
def test_replay_equals_brute_force(spark, increments):
    refs, parents = world(3)
    ledger = replay(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), increments=increments)
    assert sorted(tuple(r) for r in snapshot(ledger).collect()) == brute(refs, parents)


def test_arrivals_resolve_and_deletions_reopen(spark):
    ref = lambda rows: spark.createDataFrame(rows, REF)
    par = lambda rows: spark.createDataFrame(rows, PAR)
    one = advance(None, ref([("s", "A", "t", D + timedelta(5), 0)]), par([]))
    assert [r["cause"] for r in snapshot(one).collect()] == ["MISSING"]
    two = advance(one, ref([]), par([("s", "A", "A", D, None, 0)]))
    assert snapshot(two).collect() == []
    three = advance(two, ref([("s", "B", "t", D, 0)]), par([("s", "A", "A", D, D + timedelta(5), 0)]))
    assert sorted((r["ref_key"], r["cause"]) for r in snapshot(three).collect()) == [("A", "DELETED"), ("B", "MISSING")]
    assert sorted(tuple(r) for r in snapshot_counts(three).collect()) == [("t", "2021-01", "DELETED", 1), ("t", "2021-01", "MISSING", 1)]


def test_empty(spark):
    assert snapshot(replay(spark.createDataFrame([], REF), spark.createDataFrame([], PAR))).collect() == []
