"""Listing segments, identity links, entities, the point-in-time universe and adjusted returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import drop_written, write_out


def listing_segments(rows: DataFrame, *, key: str, isin: str, day: str, max_gap: int = 21) -> DataFrame:
    """(key, isin, part, first, last, n_sessions): runs of a key and ISIN.

    Without an ISIN a run is also cut where more than max_gap sessions of the market pass between
    two rows. Positions number the distinct days of the whole table, bounded by the calendar.
    """
    days = rows.select(day).distinct().withColumn("_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)))
    x = rows.select(key, isin, day).distinct().join(days, day)
    w = Window.partitionBy(key, isin).orderBy("_pos")
    gap = F.col("_pos") - F.lag("_pos").over(w)
    x = x.withColumn("_new", (gap.isNull() | (F.col(isin).isNull() & (gap > max_gap))).cast("int"))
    x = x.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, isin, "part").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n_sessions"))


def entities(nodes: DataFrame, links: DataFrame, *, first: str | None = None, as_of=None) -> DataFrame:
    """(node, entity): connected groups of nodes over links (a, b, effective).

    entity is the smallest node of the group or, with first, the node of the earliest first (then
    the smallest). With as_of only links effective by that day count; links to unknown nodes don't.
    Each round takes minimum neighbours, jumps the pointers once and contracts the edges to them,
    until no edge is left; every round is written out and removed at the end.
    """
    rank = F.struct(*([F.col(first)] if first else []), F.col("node"))
    named, n_path = write_out(nodes.select("node", rank.alias("rank")))
    e = links if as_of is None else links.where(F.col("effective") <= F.lit(as_of))
    end = lambda c: named.select(F.col("node").alias(c), F.col("rank").alias(f"{c}_rank"))
    pairs = e.select("a", "b").where("a != b").distinct().join(end("a"), "a").join(end("b"), "b")
    edges, path = write_out(pairs.select(F.least("a_rank", "b_rank").alias("a"), F.greatest("a_rank", "b_rank").alias("b")).distinct())
    paths, label = [n_path, path], named.select("node", "rank", F.col("rank").alias("label"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m")).select("at", F.least("at", "m").alias("to"))
        # the pointer of the pointer: labels only fall, so there are no cycles
        hop = least.join(least.select(F.col("at").alias("to"), F.col("to").alias("above")), "to").select("at", F.col("above").alias("to"))
        pointer, path = write_out(hop)
        paths.append(path)
        label = label.join(pointer.select(F.col("at").alias("label"), F.col("to").alias("_to")), "label", "left").select("node", "rank", F.coalesce("_to", "label").alias("label"))
        step = lambda c: pointer.select(F.col("at").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        moved = edges.join(step("a"), "a").join(step("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges, path = write_out(moved.where("a != b").distinct())
        paths.append(path)
    result, _ = write_out(label.select("node", F.col("label.node").alias("entity")))
    drop_written(nodes.sparkSession, *paths)
    return result


def universe(panel: DataFrame, *, window: int, least_valid: int, top: int) -> DataFrame:
    """(selection_date, entity, valid_sessions, median_value, place, status) at every month end.

    For each of the last sessions of a month with enough history: the median of each entity's value
    over the window of sessions, absent ones as 0; entities with too few valid sessions or not
    traded on the day are excluded; the others are ranked by median, then entity. Only sessions in
    the window are joined (position range as an equality on the selection's session list).
    """
    days = panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    ends = days.withColumn("m", F.trunc("date", "MM")).groupBy("m").agg(F.max("date").alias("selection_date"), F.max("pos").alias("end")).where(F.col("end") >= window)
    steps = ends.select("selection_date", F.explode(F.sequence(F.col("end") - window + 1, F.col("end"))).alias("pos"))
    held = panel.join(days, "date").join(steps, "pos")
    # zeros need no rows: they only shift the median's place among the sorted values
    g = held.groupBy("selection_date", "entity").agg(F.count("value").alias("valid_sessions"), F.sort_array(F.collect_list("value")).alias("v"), F.max((F.col("date") == F.col("selection_date")).cast("int")).alias("on_day"))
    lo, hi = (window - 1) // 2, window // 2
    at = lambda i: F.coalesce(F.get("v", F.lit(i) - (window - F.size("v"))), F.lit(0.0))
    g = g.withColumn("median_value", (at(lo) + at(hi)) / 2)
    status = F.when(F.col("valid_sessions") < least_valid, "TOO_FEW_SESSIONS").when(F.col("on_day") == 0, "NOT_TRADED")
    g = g.withColumn("reason", status)
    place = F.row_number().over(Window.partitionBy("selection_date", F.col("reason").isNull()).orderBy(F.col("median_value").desc(), "entity"))
    g = g.withColumn("place", F.when(F.col("reason").isNull(), place))
    return g.select("selection_date", "entity", "valid_sessions", "median_value", "place", F.coalesce("reason", F.when(F.col("place") <= top, "MEMBER").otherwise("ELIGIBLE_NOT_SELECTED")).alias("status"))


def adjusted_returns(rows: DataFrame, events: DataFrame, *, jump: float = 1.4) -> DataFrame:
    """rows (entity, date, close) with ret_raw, event_factor, event_status, ret_adj and return_status.

    An event meets the entity's first row on or after its day (the half-open interval after the
    previous row); factors of one row multiply. The first true status of the ladder holds.
    """
    from marketloom.functions.subjects import continuity
    from marketloom.operators.joins import asof_forward

    w = Window.partitionBy("entity").orderBy("date")
    x = rows.select("entity", "date", "close", F.lag("date").over(w).alias("prev_date"), F.lag("close").over(w).alias("prev_close"))
    x = x.withColumn("ret_raw", F.try_divide("close", "prev_close") - 1)
    hit = asof_forward(events, rows, "entity", "ex_date", "date").groupBy("entity", F.col("matched_day").alias("date")).agg(F.product("factor").alias("event_factor"), F.count(F.lit(1)).alias("n_events"))
    x = x.join(hit, ["entity", "date"], "left").withColumn("event_status", F.when(F.col("event_factor").isNotNull() & (F.col("ret_raw") > -1), continuity(1 + F.col("ret_raw"), F.col("event_factor"))))
    good = F.coalesce(F.col("event_status") == "VALIDATED", F.lit(False))
    x = x.withColumn("ret_adj", F.when(good, F.try_divide("close", F.col("prev_close") * F.col("event_factor")) - 1))
    ratio = F.when(good, 1 + F.col("ret_adj")).otherwise(1 + F.col("ret_raw"))
    status = (
        F.when(F.col("prev_date").isNull(), "FIRST_OBSERVATION")
        .when(~F.coalesce((F.col("close") > 0) & (F.col("prev_close") > 0), F.lit(False)), "MISSING_PRICE")
        .when(F.col("event_status") == "DISCREPANT", "EVENT_DISCREPANT")
        .when(F.col("event_status") == "INCONCLUSIVE", "EVENT_INCONCLUSIVE")
        .when(F.abs(F.log(ratio)) > F.log(F.lit(jump)), "UNEXPLAINED_JUMP")
        .when(good, "ADJUSTED_VALIDATED")
        .otherwise("OK")
    )
    return x.withColumn("return_status", status)
