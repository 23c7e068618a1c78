"""Streams of bars: late-safe collection, resampling and a stateful trader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COST = 0.001
TRADE_SCHEMA = "symbol string, ts timestamp, action string, price double"
STATE_SCHEMA = "last_ts timestamp, fast double, slow double, units double, cash double, pending string"


def collect_new(stream: DataFrame, *, delay: str = "3 days") -> DataFrame:
    """Each bar once: copies of (symbol, ts) that arrive within the delay are dropped, older state is let go."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def resample(stream: DataFrame, *, width: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """OHLC of each symbol and event-time window."""
    at = F.window("ts", width)
    return (
        stream.withWatermark("ts", delay)
        .groupBy("symbol", at.alias("w"))
        .agg(F.min_by("price", F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "price")).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def trade_bars(symbol: str, rows: pd.DataFrame, state: tuple | None, *, fast: int = 20, slow: int = 50) -> tuple[pd.DataFrame, tuple]:
    """Trades of one symbol over bars sorted by ts, and the state after them.

    A decision at a close is filled at the next bar's open. Bars not newer than the state's last
    one have been seen and are skipped, so a replay changes nothing.
    """
    last, f, s, units, cash, pending = state or (None, None, None, 0.0, 100_000.0, "")
    a, b, out = 2 / (fast + 1), 2 / (slow + 1), []
    for ts, opened, close in rows[["ts", "open", "close"]].itertuples(index=False):
        if last is not None and ts <= last:
            continue
        if pending == "BUY" and units == 0:
            units, cash = cash * (1 - COST) / opened, 0.0
            out.append((symbol, ts, "BUY", opened))
        elif pending == "SELL" and units > 0:
            units, cash = 0.0, units * opened * (1 - COST)
            out.append((symbol, ts, "SELL", opened))
        f, s = (close, close) if f is None else (close * a + f * (1 - a), close * b + s * (1 - b))
        pending = "BUY" if f > s and units == 0 else "SELL" if f <= s and units > 0 else ""
        last = ts
    return pd.DataFrame(out, columns=["symbol", "ts", "action", "price"]), (last, f, s, units, cash, pending)


def trade_stream(stream: DataFrame) -> DataFrame:
    """Trades of every symbol as bars arrive; state is kept per symbol across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts")
        trades, after = trade_bars(key[0], rows, state.get if state.exists else None)
        state.update(after)
        yield trades

    return stream.select("symbol", "ts", "open", "close").groupBy("symbol").applyInPandasWithState(step, TRADE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def trade_batch(bars: DataFrame) -> DataFrame:
    """The same trades by replaying all bars at once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return trade_bars(rows["symbol"].iloc[0], rows.sort_values("ts"), None)[0]

    return bars.select("symbol", "ts", "open", "close").groupBy("symbol").applyInPandas(run, TRADE_SCHEMA)
