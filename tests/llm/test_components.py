import random

from marketloom.llm.components import group_links

SCHEMA = "from_segment string, to_segment string, node string, root int"


def groups(spark, pairs):
    rows = [(a, b, "clash", 0) for a, b in pairs]
    return {r["node"]: r["group"] for r in group_links(spark.createDataFrame(rows, SCHEMA), "from_segment", "to_segment").collect()}


def brute(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b:
            for v in (a, b):
                up.setdefault(v, v)
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


def test_dirty_links(spark):
    pairs = [("B", "A"), ("A ", "\tB"), ("B", "C"), ("C", "B"), ("D", "D"), ("E", None), (None, "F"), ("G", "  "), (None, None), ("H", "I"), ("H", "I"), ("é", "z")]
    got = groups(spark, pairs)
    assert got == brute(pairs) == {"A": "A", "B": "A", "C": "A", "D": "D", "H": "H", "I": "H", "z": "z", "é": "z"}


def test_long_chain_and_star(spark):
    rng = random.Random(1)
    names = [f"{i:04d}" for i in range(400)]
    rng.shuffle(names)
    pairs = list(zip(names, names[1:])) + [("hub", f"s{i}") for i in range(300)]
    assert groups(spark, pairs) == brute(pairs)


def test_random_graph(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)]
    assert groups(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert groups(spark, []) == {} and groups(spark, [(None, "a")]) == {}


def test_finishing_in_one_task_changes_nothing_and_one_table_is_left(spark, tmp_path):
    import os
    import random

    rng = random.Random(2)
    links = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(260)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"h{i}") for i in range(90)]
    df = spark.createDataFrame(links, "a string, b string")
    slow = {tuple(r) for r in group_links(df, "a", "b", last_edges=0).collect()}
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = {f for f in os.listdir(root) if f.startswith("table-")}
    quick = {tuple(r) for r in group_links(df, "a", "b", last_edges=50).collect()}
    assert quick == slow and len({g for _, g in slow if g.startswith("c")}) == 1
    assert len({f for f in os.listdir(root) if f.startswith("table-")} - before) == 1
