"""Queries on small tables of their own, against loops over the same rows."""

import math
import random
from datetime import date, timedelta

from marketloom.queries import registry


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))


def _rows(spark, folder, name):
    return sorted(tuple(r) for r in registry.queries()[name](spark, str(folder)).collect())


def test_jump_pairs_beyond_the_reference_cut(spark, tmp_path):
    rng, rows = random.Random(5), []
    for s in ("A", "B"):
        price = 100.0
        for i in range(130):
            price *= rng.choice([1.0, 1.0, 1.0, 1.35, 1 / 1.35, 1.45, 1 / 1.45, 2.0, 0.5, 6.0, 1 / 6])
            rows.append((len(rows), s, date(2000, 1, 1) + timedelta(i), price))
    _write(spark, tmp_path, "orders", rows, "o_orderkey bigint, o_orderpriority string, o_orderdate date, o_totalprice double")
    want = []
    for s in ("A", "B"):
        x = [r for r in rows if r[1] == s]
        lr = [0.0] + [math.log(b[3] / a[3]) for a, b in zip(x, x[1:])]
        big = [i for i, v in enumerate(lr) if abs(v) > math.log(1.4)]
        want += [(s, x[i][2], x[j][2]) for i in big for j in big if 1 < j - i <= 20 and lr[i] * lr[j] < 0 and abs(lr[i] + lr[j]) < 0.15]
    assert _rows(spark, tmp_path, "join_jump_pairs") == sorted(want) and len(want) > 100


def test_entities_of_segments_and_their_links(spark, tmp_path):
    rng, day = random.Random(3), date(2020, 6, 30)
    keys = [f"S{i:03d}" for i in range(120)]
    first = {k: day + timedelta(rng.randint(-900, 300)) for k in keys}
    pairs = [(keys[i], keys[i + 1]) for i in range(40)]  # a chain
    pairs += [(keys[60], keys[60 + i]) for i in range(1, 30)]  # a hub
    pairs += [(rng.choice(keys[95:]), rng.choice(keys[95:])) for _ in range(12)] + [("S050", "gone"), ("gone", "S051"), ("out", "away"), ("S052", None), (None, "S053")]
    links = [(a, b, rng.choice([None, day, day + timedelta(1), day - timedelta(90), day - timedelta(9)])) for a, b in pairs]
    _write(spark, tmp_path, "id1_segments", [(k, first[k]) for k in keys], "segment_id string, first date")
    dirty = [(f" {a}\t" if a else a, f"{b} " if b else b, eff) for a, b, eff in links]
    _write(spark, tmp_path, "returns_links", dirty + dirty[::3], "from_segment string, to_segment string, effective date")

    def groups(nodes, edges, order):
        label = {k: k for k in nodes}
        for _ in nodes:
            for a, b in edges:
                if a in label and b in label:
                    label[a] = label[b] = min(label[a], label[b], key=order)
        return sorted(label.items())

    whole, held = [x[:2] for x in links if x[0] and x[1]], [(a, b) for a, b, eff in links if a and b and eff and eff <= day]
    assert _rows(spark, tmp_path, "id_entities") == groups({*keys, *sum(whole, ())}, whole, lambda k: k)
    known = {k for k in keys if first[k] <= day} | {k for k in sum(held, ()) if k not in first}
    assert _rows(spark, tmp_path, "id_entities_as_of") == groups(known, held, lambda k: (first.get(k, date.max), k))
