import bisect
import random
from collections import Counter, defaultdict

import pytest

import marketloom.llm.packing as packing
from marketloom.llm.packing import pack, plan_containers

KINDS = "container_kind string, capacity_tokens int, n int"


def one_by_one(lengths, capacity):
    rooms, n = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, size)
        if i < len(rooms):
            r = rooms.pop(i)
        else:
            r, n = capacity, n + 1
        if r > size:
            bisect.insort(rooms, r - size)
    return n


def test_plan_equals_best_fit_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([5, 16, 50])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
        h = Counter(sizes)
        slots, n = plan_containers(h, cap)
        assert n == one_by_one(sizes, cap)
        load, seen = Counter(), defaultdict(list)
        for size, rank, k, first, per in slots:
            for j in range(k):
                load[first + j // per] += size
                seen[size].append(rank + j)
        assert set(load) == set(range(n)) and all(v <= cap for v in load.values())
        assert set(seen) == set(h) and all(sorted(v) == list(range(h[s])) for s, v in seen.items())
    with pytest.raises(ValueError):
        plan_containers({9: 1}, 8)
    assert plan_containers({}, 8) == ([], 0) and plan_containers({0: 3}, 8) == ([(0, 0, 3, 0, 3)], 1)


@pytest.mark.parametrize("bucket_rows", [200_000, 7])
def test_every_item_whole_in_every_kind(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(2)
    sizes = {i: 10 if rng.random() < 0.4 else rng.choice([0, 0, 1, 3, 17, 40, 64, 65, 200, 129]) for i in range(400)}
    items = spark.createDataFrame([(i, n if n or i % 2 else None, 0) for i, n in sizes.items()], "doc_id long, n_tokens int, piece int")
    kinds = spark.createDataFrame([("s", 64, 0), ("m", 200, 0), ("m", 200, 0), ("z", 0, 0), (None, 5, 0), ("y", None, 0)], KINDS)
    rows = pack(items, kinds).collect()
    for kind, cap in (("s", 64), ("m", 200)):
        own = [r for r in rows if r["container_kind"] == kind]
        load, parts = Counter(), defaultdict(list)
        for r in own:
            load[r["container_no"]] += r["n"]
            parts[r["doc_id"]].append((r["piece"], r["start"], r["n"]))
        assert set(parts) == set(sizes) and max(load.values()) <= cap and set(load) == set(range(max(load) + 1))
        for i, p in parts.items():
            p.sort()
            assert sum(n for *_, n in p) == sizes[i] and (len(p) == 1 or sizes[i] > cap)
            assert all(n == cap for *_, n in p[:-1]) and [s for _, s, _ in p] == [cap * k for k in range(len(p))]
        pieces = [n for p in parts.values() for *_, n in p if n]
        assert len(load) == one_by_one(pieces, cap)
    assert {r["container_kind"] for r in rows} == {"s", "m"}


def test_empty(spark):
    items, kinds = spark.createDataFrame([], "doc_id long, n_tokens int"), spark.createDataFrame([("s", 64, 0)], KINDS)
    assert pack(items, kinds).collect() == [] and pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens int"), kinds.limit(0)).collect() == []
