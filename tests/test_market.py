import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import backtest as B
from marketloom.operators import identity as N
from marketloom.operators import quality as Q
from marketloom.operators import stats as T
from marketloom.operators.joins import asof_forward, interval_lookup, require_one_to_one
from marketloom.operators.registry import broken_link, chain_hash, fold_log
from marketloom.streaming.bars import collect_new, resample, trade_batch, trade_stream

D = date(2024, 1, 1)


def bars(spark, positions, opens=None, closes=None):
    n = len(positions)
    opens, closes = opens or [100.0 + i for i in range(n)], closes or [100.5 + i for i in range(n)]
    return spark.createDataFrame([("S", D + timedelta(i), float(opens[i]), float(closes[i]), positions[i]) for i in range(n)], "symbol string, ts date, open double, close double, position int")


def simulate(opens, closes, positions, cost=0.001):
    cash, units, out = 100_000.0, 0.0, []
    for i in range(len(opens)):
        want = positions[i - 1] if i else 0
        if units and not want:
            cash, units = units * opens[i] * (1 - cost), 0.0
        elif not units and want:
            units, cash = cash * (1 - cost) / opens[i], 0.0
        out.append(cash + units * closes[i])
    return out


def test_equity_equals_a_loop(spark):
    rng = random.Random(2)
    n = 120
    p, o, c = [rng.randrange(2) for _ in range(n)], [rng.uniform(50, 150) for _ in range(n)], [rng.uniform(50, 150) for _ in range(n)]
    got = [r["equity"] for r in B.equity_curve(bars(spark, p, o, c)).sort("ts").collect()]
    assert got == pytest.approx(simulate(o, c, p), rel=1e-12)


def test_no_look_ahead(spark):
    p = [1, 1, 0, 0, 1, 1, 1, 0]
    whole = B.equity_curve(bars(spark, p)).sort("ts").collect()
    part = B.equity_curve(bars(spark, p).where(F.col("ts") < D + timedelta(5))).sort("ts").collect()
    assert [r["equity"] for r in whole[:5]] == [r["equity"] for r in part]


def test_stops_and_the_blocked_run(spark):
    closes = [100, 100, 40, 100, 100, 100, 100]
    one = B.stopped_trades(bars(spark, [1, 1, 0, 1, 1, 1, 1], [100.0] * 7, closes), stop_loss=0.5).collect()
    assert [r["reason"] for r in one] == ["stop"]  # blocked until a later bar sees the signal off
    two = B.stopped_trades(bars(spark, [1, 1, 0, 0, 1, 1, 1], [100.0] * 7, closes), stop_loss=0.5).sort("entry_ts").collect()
    assert [r["reason"] for r in two] == ["stop", "open"] and two[1]["exit"] is None
    free = B.stopped_trades(bars(spark, [1, 1, 0, 1, 1, 1, 1], [100.0] * 7, closes)).sort("entry_ts").collect()
    plain = B.round_trips(B.equity_curve(bars(spark, [1, 1, 0, 1, 1, 1, 1], [100.0] * 7, closes))).sort("entry_ts").collect()
    assert [(r["entry_ts"], r["exit_ts"]) for r in free] == [(r["entry_ts"], r["exit_ts"]) for r in plain]


def test_joins(spark):
    ev = spark.createDataFrame([("a", 1, D), ("a", 2, D + timedelta(3)), ("a", 3, D + timedelta(9)), ("b", 4, D)], "k string, id int, day date")
    rows = spark.createDataFrame([("a", D), ("a", D + timedelta(5)), ("a", D + timedelta(5))], "k string, d date")
    assert sorted((r["id"], r["matched_day"]) for r in asof_forward(ev, rows, "k", "day", "d").collect()) == [(1, D), (2, D + timedelta(5))]
    p = spark.createDataFrame([("a", D, None, 1.0), ("a", D + timedelta(9), None, 2.0)], "k string, s date, e date, rate double")
    good = interval_lookup(ev.where("id < 3"), p, "k", "day", "s", "e", "rate")
    assert sorted((r["id"], r["rate"]) for r in good.collect()) == [(1, 1.0), (2, 1.0)]
    for bad in (ev.where("id = 3"), ev.where("id = 4")):
        with pytest.raises(Exception, match="one period"):
            interval_lookup(bad, p, "k", "day", "s", "e", "rate").collect()
    with pytest.raises(Exception, match="one to one"):
        require_one_to_one(ev.select("k"), ev.select("k"), ["k"]).collect()


def test_entities_of_a_chain_and_a_cycle(spark):
    nodes = spark.createDataFrame([(i, D - timedelta(i)) for i in range(60)], "node int, first date")
    edges = [(i, i + 1, D) for i in range(0, 40)] + [(50, 51, D), (51, 52, D), (52, 50, D), (55, 55, D), (53, 54, D + timedelta(9))]
    links = spark.createDataFrame(edges, "a int, b int, effective date")
    got = {r["node"]: r["entity"] for r in N.entities(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[52] == 50 and got[55] == 55 and got[54] == 53 and got[45] == 45
    late = {r["node"]: r["entity"] for r in N.entities(nodes, links, first="first", as_of=D).collect()}
    assert late[0] == 40 and late[54] == 54 and late[50] == 52


def test_quality(spark):
    rows = [("S", "2024-01-02", "09:00", 1.0, 2.0, 0.5, 1.5, 1), ("S", "2024-01-02", "09:00", 1.0, 2.0, 0.5, 1.5, 1), ("S", "2024-01-03", "09:00", 1.0, 0.9, 0.5, 1.5, 1), ("S", "2024-01-04", "09:00", 1.0, 2.0, 0.5, 1.5, 1)]
    b = spark.createDataFrame(rows, "symbol string, session string, time string, open double, high double, low double, close double, volume long")
    clean, broken = Q.split_defective(b, ["09:00"])
    assert sorted((r["session"], r["reasons"]) for r in broken.collect()) == [("2024-01-02", "duplicate"), ("2024-01-03", "impossible")] and clean.count() == 1
    with pytest.raises(Exception, match="no"):
        Q.require(b, F.col("high") > 1, "no").collect()
    assert Q.fingerprint(b).first() == Q.fingerprint(b.repartition(3).sort("session")).first()


def test_statistics(spark):
    rng = random.Random(1)
    x = [rng.gauss(0.1, 1) for _ in range(200)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "g string, i int, v double")
    r = T.newey_west(df, "g", "i", "v", 3).first()
    m = sum(x) / 200
    d = [v - m for v in x]
    lrv = sum(v * v for v in d) / 200 + sum(2 * (1 - k / 4) * sum(d[i] * d[i - k] for i in range(k, 200)) / 200 for k in (1, 2, 3))
    assert r["lrv"] == pytest.approx(lrv) and r["n"] == 200 and [T.lag_rule(n) for n in (114, 56, 170)] == [4, 3, 4]
    acov = [sum(d[i] * d[i + k] for i in range(200 - k)) / 200 for k in range(40)]
    assert 1 <= T.block_length(acov, 200) <= 43
    one, two = (sorted(map(tuple, T.bootstrap_means(spark, x, 3.0, 1200, 7, per_task=400).collect())) for _ in range(2))
    assert one == two and len(one) == 1200 and sum(v for _, v in one) / 1200 == pytest.approx(m, abs=0.02)
    assert T.root(lambda v: v - 2.5, 0, 10) == pytest.approx(2.5) and T.root(lambda v: 1 + v * v, 0, 1) is None
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: (round(r["holm"], 6), round(r["bh"], 6)) for r in T.benjamini_hochberg(T.holm(t)).collect()} == {"a": (0.03, 0.03), "b": (0.06, 0.04), "c": (0.06, 0.04)}


def test_registry(spark):
    log = spark.createDataFrame([("e", 1, "open", None), ("e", 2, None, 5), ("e", 3, "closed", None)], "id string, line int, state string, n int")
    assert fold_log(log, "id", "line", ["state", "n"]).first() == ("e", "closed", 5, 3)
    records, previous = [], ""
    for i in range(3):
        previous = chain_hash(previous, {"i": i})
        records.append({"i": i, "hash": previous})
    assert broken_link(records) is None
    records[1]["i"] = 9
    assert broken_link(records) == 1


def test_streams(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), rng.uniform(90, 110), rng.uniform(90, 110)) for s in "AB" for i in range(150)]
    schema = "symbol string, ts timestamp, open double, close double"
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, schema)
    cut = datetime(2024, 3, 1)
    df.where(F.col("ts") < F.lit(cut)).coalesce(1).write.mode("append").parquet(str(src))

    def run(stream, name, mode="append"):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run(trade_stream(spark.readStream.schema(schema).parquet(str(src))), "trades")
    df.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(str(src))
    run(trade_stream(spark.readStream.schema(schema).parquet(str(src))), "trades")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "trades")).collect()))
    assert got == sorted(map(tuple, trade_batch(df).collect())) and got
    twice = tmp_path / "twice"
    for _ in range(2):
        df.limit(50).coalesce(1).write.mode("append").parquet(str(twice))
    run(collect_new(spark.readStream.schema(schema).parquet(str(twice))), "once")
    assert spark.read.parquet(str(tmp_path / "once")).count() == 50
    ticks = spark.createDataFrame([("A", datetime(2024, 1, 1, 9, m), float(m)) for m in range(0, 59)] + [("A", datetime(2024, 1, 1, 20), 1.0)], "symbol string, ts timestamp, price double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    run(resample(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))), "bars")
    first = spark.read.parquet(str(tmp_path / "bars")).sort("ts").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (0.0, 14.0, 0.0, 14.0, 15)
