"""Implausible readings in measurement series.

Per source a local-level state-space model of the log price is run: the state moves by the
source's own daily scale, each row brings two measurements (prev_close and close) and possibly a
known factor between them. Three innovations are standardised: of prev_close and of close against
the filtered level, and of close against the row's own prev_close (of ret_raw, where one of the
two is missing). A reading whose standardised innovation exceeds the threshold is flagged and
withheld from the update. The variance of the last innovations from reading to reading is
tracked as well: where it vanishes over more readings than the source's usual quiet stretches,
the readings are stuck. Values impossible in themselves, or contradicting each other beyond
rounding, need no model; that check is named `invalid` and comes before the filter.

A source's scale and usual quiet stretch are aggregates. Its series is read in order, in batches,
by one task, and the filter's state is carried from batch to batch: a task holds one batch and
the rows that a later one may still change, never a whole series. A batch steps through all its
series at once as arrays.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SpikeRules:
    """threshold: standardised innovation from which a reading is withheld.
    rounding: largest difference of ret_raw from close / prev_close - 1 that rounding explains.
    scale_floor: least daily scale of a source. confirm: so many withheld readings in a row that
    agree with each other make a new level. opening: the level before a series is the median of
    so many first readings. run_floor, run_factor: innovations vanish where more than run_floor - 2
    of them and more than run_factor times the source's usual (90 %) quiet stretch are zero."""

    threshold: float = 7.0
    rounding: float = 1e-4
    scale_floor: float = 2e-4
    confirm: int = 25
    opening: int = 15
    run_floor: int = 8
    run_factor: float = 2.0


_COLUMNS = ["residual_id", "_series", "_day", "prev_close", "close", "ret_raw", "_factor", "_scale", "_usual"]


@dataclass
class Carried:
    """What a series leaves behind at the end of a batch.

    rows may still change or are still to be filtered: too few rows to open the series, a run of
    withheld readings that may become a level, the window of the innovations' variance. flags and
    stuck are those of the rows filtered so far, state is what the filter goes on with.
    """

    rows: pd.DataFrame
    flags: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    stuck: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    state: dict = field(default_factory=dict)


def invalid(prev: np.ndarray, close: np.ndarray, ret: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Rows with a value impossible in itself, or values that contradict each other beyond rounding."""
    with np.errstate(all="ignore"):
        impossible = (prev <= 0) | np.isinf(prev) | (close <= 0) | np.isinf(close) | (ret <= -1) | np.isinf(ret)
        apart = np.abs(ret - (close / prev - 1))
        return impossible | (np.isfinite(apart) & (apart > rules.rounding))


def judge(rows: pd.DataFrame, rules: SpikeRules, carried: Carried | None = None, more: bool = False) -> tuple[pd.DataFrame, np.ndarray, Carried | None]:
    """(rows, flags, carried) for rows sorted by (_series, _day).

    carried is what the first series left behind; with more the last series may go on in the next
    batch, and its open rows are carried instead of returned.
    """
    carried = carried or Carried(rows.iloc[:0])
    rows = pd.concat([carried.rows, rows], ignore_index=True) if len(carried.rows) else rows.reset_index(drop=True)
    if not len(rows):
        return rows, np.zeros(0, dtype=bool), None
    series = rows["_series"].to_numpy()
    starts = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
    later = None
    if more and len(rows) - starts[-1] < rules.opening and not (len(starts) == 1 and carried.state):
        # too few rows to open the last series
        later = Carried(rows.iloc[starts[-1] :].reset_index(drop=True))
        rows, starts, more = rows.iloc[: starts[-1]], starts[:-1], False
        if not len(rows):
            return rows, np.zeros(0, dtype=bool), later
    n = len(rows)
    length = np.diff(np.r_[starts, n])
    with np.errstate(all="ignore"):
        prev, close, ret = (rows[c].to_numpy(dtype=float) for c in ("prev_close", "close", "ret_raw"))
        factor = rows["_factor"].to_numpy(dtype=float)
        gain = np.log(np.where(np.isfinite(factor) & (factor > 0), factor, 1.0))
        before, after = np.log(np.where((prev > 0) & np.isfinite(prev), prev, np.nan)), np.log(np.where((close > 0) & np.isfinite(close), close, np.nan))
        step = np.log1p(np.where((ret > -1) & np.isfinite(ret), ret, np.nan))
        scale = np.maximum(np.nan_to_num(rows["_scale"].to_numpy(dtype=float), nan=rules.scale_floor), rules.scale_floor)
        quiet = _window(np.nan_to_num(rows["_usual"].to_numpy(dtype=float), nan=0.0), rules)
        level, last = _innovations(before, after, gain, scale, rows["_day"].to_numpy(dtype=np.int64), starts, length, carried, rules)
        # the row's own transition: its level is its prev_close, exactly, and moves by one day's scale
        moved = np.where(np.isfinite(after - before), after - before, step) - gain
        own = np.isfinite(moved) & (np.abs(moved) > rules.threshold * scale)
        stuck = _vanished(close, scale, quiet, starts)
        stuck[: len(carried.stuck)] |= carried.stuck
        flags = level | own | stuck | invalid(prev, close, ret, rules)
    if not more:
        return rows, flags, later
    # the window is measured in closes, of which one more than innovations is needed
    closes = np.flatnonzero(np.isfinite(close[starts[-1] :]))
    need = int(quiet[-1]) + 1
    back = int(closes[-need]) if len(closes) >= need else 0
    if last["agree"] > 0:
        back = min(back, max(int(last["since"]), 0))
    cut = int(starts[-1]) + back
    last["since"] -= back
    return rows.iloc[:cut], flags[:cut], Carried(rows.iloc[cut:].reset_index(drop=True), level[cut:], stuck[cut:], last)


def _innovations(before, after, gain, scale, day, starts, length, carried: Carried, rules: SpikeRules) -> tuple[np.ndarray, dict]:
    """Kalman filter over many series at once: step i is row i of every series that has one.

    The rows that the first series carried are filtered already. Returns the flags of the level's
    innovations and the state of the last series.
    """
    flags = np.zeros(len(before), dtype=bool)
    flags[: len(carried.flags)] = carried.flags
    begun = np.zeros(len(starts), dtype=int)
    begun[0] = len(carried.flags)
    state = _initial(before, after, gain, starts, length, scale, rules.opening)
    for name, value in carried.state.items():
        state[name][0] = value
    level, var, last, agree, other, since, wrong = (state[k] for k in ("level", "var", "last", "agree", "other", "since", "wrong"))
    for i in range(int(length.max(initial=0))):
        live = np.flatnonzero((length > i) & (begun <= i))
        if not len(live):
            continue
        at = starts[live] + i
        q = scale[at] ** 2
        # sessions since the last row: a weekend is no gap
        gap = np.maximum(np.busday_count(last[live].astype("datetime64[D]"), day[at].astype("datetime64[D]")), 1)
        x, p = level[live], var[live] + q * gap
        noise = 0.01 * q
        # prev_close speaks of the level before the day's factor
        u = before[at] - x
        seen = np.isfinite(u)
        off_prev = seen & ((np.abs(u) > rules.threshold * np.sqrt(p + noise)) | (before[at] == wrong[live]))
        use = seen & ~off_prev
        k = np.where(use, p / (p + noise), 0.0)
        x, p = x + k * np.where(use, u, 0.0), np.where(use, (1 - k) * p + q, p)
        x = x + gain[at]
        v = after[at] - x
        seen_close = np.isfinite(v)
        off_close = seen_close & (np.abs(v) > rules.threshold * np.sqrt(p + noise))
        use = seen_close & ~off_close
        k = np.where(use, p / (p + noise), 0.0)
        x, p = x + k * np.where(use, v, 0.0), np.where(use, (1 - k) * p, p)
        flags[at] = off_prev | off_close
        # a wrong close that the next row repeats as its prev_close
        wrong[live] = np.where(off_close, after[at], np.nan)
        # readings withheld in a row that agree with each other, up to a confirmed new level
        near = off_close & np.isfinite(other[live]) & (np.abs(after[at] - gain[at] - other[live]) <= rules.threshold * scale[at] * np.sqrt(gap))
        since[live] = np.where(near, since[live], i)
        agree[live] = np.where(off_close, np.where(near, agree[live] + 1, 1), np.where(seen_close, 0, agree[live]))
        other[live] = np.where(off_close, after[at], np.where(seen_close, np.nan, other[live]))
        confirmed = agree[live] >= rules.confirm
        if confirmed.any():
            for s, run, e in zip(starts[live][confirmed], since[live][confirmed], at[confirmed]):
                flags[s + run + 1 : e + 1] = False
            x, p = np.where(confirmed, after[at], x), np.where(confirmed, noise, p)
            agree[live], wrong[live] = np.where(confirmed, 0, agree[live]), np.where(confirmed, np.nan, wrong[live])
        level[live], var[live], last[live] = x, p, day[at]
    return flags, {k: v[-1] for k, v in state.items()}


def _initial(before, after, gain, starts, length, scale, width: int) -> dict[str, np.ndarray]:
    """State before each series: the median of its first readings, without known factors."""
    m = len(starts)
    total = np.cumsum(gain)
    take = starts[:, None] + np.minimum(np.arange(width)[None, :], length[:, None] - 1)
    base = (total - gain)[starts]
    early = np.where(np.isfinite(after), after - total, np.nan)[take] + base[:, None]
    prior = np.where(np.isfinite(before), before - (total - gain), np.nan)[take] + base[:, None]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        level = np.nanmedian(np.c_[early, prior], axis=1)
    return {
        "level": level,
        "var": width * scale[starts] ** 2,
        "last": np.full(m, 10**6, dtype=np.int64),  # a last day in the far future makes the first gap one day
        "agree": np.zeros(m, dtype=int),
        "other": np.full(m, np.nan),
        "since": np.zeros(m, dtype=int),
        "wrong": np.full(m, np.nan),
    }


def _window(usual: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Innovations that must vanish together: of a run of one more close, far longer than the usual ones."""
    return np.maximum(rules.run_floor, np.floor(rules.run_factor * usual).astype(int) + 1) - 1


def _vanished(close: np.ndarray, scale: np.ndarray, quiet: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows in a window of readings over which the variance of the innovations vanishes.

    The innovation is that of a close against the last one read, standardised by the source's
    scale; its variance over the last quiet innovations is a difference of running sums. The
    reading before the window's first innovation is no part of it.
    """
    flags = np.zeros(len(close), dtype=bool)
    seen = np.flatnonzero(np.isfinite(close))
    if not len(seen):
        return flags
    c = close[seen]
    owner = np.searchsorted(starts, seen, side="right")
    head = np.r_[True, owner[1:] != owner[:-1]]
    innovation = np.r_[np.inf, np.diff(c)] / np.maximum(np.abs(c) * scale[seen], 1e-300)
    square = np.where(head, 1.0, np.where(c == np.r_[np.nan, c[:-1]], 0.0, np.clip(np.nan_to_num(innovation**2, nan=1.0, posinf=1e6), 1e-6, 1e6)))
    total = np.r_[0.0, np.cumsum(square)]
    k = np.arange(1, len(seen) + 1)
    width = quiet[seen]
    variance = np.where(k >= width, (total[k] - total[np.maximum(k - width, 0)]) / width, np.inf)
    ends = np.flatnonzero(variance == 0.0)
    # every row of every window that vanished
    cover = np.zeros(len(seen) + 1, dtype=int)
    np.add.at(cover, ends + 1 - width[ends], 1)
    np.add.at(cover, ends + 1, -1)
    flags[seen] = np.cumsum(cover[:-1]) > 0
    return flags


def _scales(base: DataFrame) -> DataFrame:
    """(_series, _scale, _usual): a source's daily scale, the median of its moves, and its usual run of unchanged closes, the 90 % one.

    base is partitioned by _series, so that no exchange is needed.
    """
    usable = "prev_close > 0 and close > 0 and not isnan(prev_close) and not isnan(close) and prev_close < double('inf') and close < double('inf')"
    factor = F.when((F.col("_factor") > 0) & ~F.isnan("_factor"), F.col("_factor")).otherwise(1.0)
    move = F.when(F.expr(usable), F.abs(F.log(F.col("close") / F.col("prev_close") / factor)))
    scale = base.groupBy("_series").agg((F.percentile_approx(F.when(move > 1e-9, move), 0.5, 10000) / 0.6745).alias("_scale"))
    order = Window.partitionBy("_series").orderBy("_day", "residual_id")
    read = base.where("close is not null and not isnan(close) and abs(close) < double('inf')").select("_series", "_day", "residual_id", "close")
    runs = read.withColumn("_new", (~F.col("close").eqNullSafe(F.lag("close").over(order))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    sizes = runs.groupBy("_series", "_run").agg(F.count(F.lit(1)).alias("_size")).groupBy("_series", "_size").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_series").orderBy("_size")
    ranked = sizes.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_series")))
    usual = ranked.where("_upto > floor(0.9 * (_all - 1))").groupBy("_series").agg(F.min("_size").alias("_usual"))
    return scale.join(usual, "_series", "left")


def implausible_readings(readings: DataFrame, *, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(residual_id): the rows with a value that is no believable reading of their entity.

    Null and NaN are missing and no case. A move that event_factor explains is no case; a factor
    that is null, NaN or not positive explains nothing. Rows without entity or date are judged by
    their own values alone (impossible, contradicting). Copies of a row count once; of rows of an
    entity and day with different ids each is judged, in id order. An empty table gives none.
    """
    # a row without entity or day is a series of its own
    alone = F.col("entity_id").isNull() | F.col("date").isNull()
    series = F.when(alone, F.concat(F.lit("\u0000"), F.col("residual_id").cast("string"))).otherwise(F.col("entity_id"))
    day = F.coalesce(F.datediff("date", F.to_date(F.lit("1970-01-01"))), F.lit(0))
    base = (
        readings.select("residual_id", series.alias("_series"), day.cast("long").alias("_day"), alone.alias("_alone"), "prev_close", "close", "ret_raw", F.col("event_factor").alias("_factor"))
        .repartition("_series")
        .distinct()
    )
    scaled = base.join(_scales(base.where("not _alone")), "_series", "left").withColumn("_scale", F.when(F.col("_alone"), F.lit(float("inf"))).otherwise(F.col("_scale")))
    # after the join, which may split a busy source: a series must be read by one task, in order
    parted = scaled.select(*_COLUMNS).repartition("_series").sortWithinPartitions("_series", "_day", "residual_id")

    def flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in batches:
            if len(batch):
                rows, bad, carried = judge(batch, rules, carried, more=True)
                yield pd.DataFrame({"residual_id": rows["residual_id"].to_numpy()[bad]})
        if carried is not None:
            rows, bad, _ = judge(carried.rows.iloc[:0], rules, carried)
            yield pd.DataFrame({"residual_id": rows["residual_id"].to_numpy()[bad]})

    return parted.mapInPandas(flagged, "residual_id long").distinct()
