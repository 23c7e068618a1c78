"""Fixed-capacity containers filled with items of varying length.

The plan is made over the histogram of lengths, not over items: best fit, longest first, on counts
of equal lengths and ranges of equal containers. Each item then takes the planned slot of its rank
within its length. The plan needs at most one histogram row per length up to the capacity on the
driver; items never leave the executors. A hot length is ranked in buckets, in two levels.

What the driver holds: a histogram of at most capacity + 1 rows per kind, and the slots planned
from it. A length adds one slot row per range of equal containers it fills and one for a rest; a
range is used up or split in two by a row, so slots are at most in proportion to the histogram's
rows plus the ranges, both bounded by the capacity, whatever the number of items.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import cut_lineage

#: Ranks of one length that share a key in the join of items and slots.
BLOCK = 64
#: Items that one ranking task holds of one length.
BUCKET_ROWS = 200_000


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots as (length, first_rank, n_items, first_container, per_container), and the containers used.

    Ranks count from 0; consecutive ranks fill a container before they go on to the next. Best
    fit: each item goes to the open container with the least room that holds it, else to a new
    one. Equal to placing the items one by one, longest first. Items of length 0 take no room and
    share the first container.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: list[int] = []  # distinct free rooms, ascending
    ranges: dict[int, list[list[int]]] = {}  # room -> [first_container, n]
    used = 0

    def give(free: int, first: int, n: int) -> None:
        if free <= 0 or n <= 0:
            return
        if free not in ranges:
            bisect.insort(room, free)
            ranges[free] = []
        ranges[free].append([first, n])

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        if length > capacity:
            raise ValueError(f"an item of {length} exceeds the capacity of {capacity}")
        while left > 0:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                free = room[at]
                first, n = ranges[free].pop()
                if not ranges[free]:
                    del ranges[free], room[at]
            else:
                free, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            per = free // length
            full = min(n, left // per)
            if full:
                slots.append((length, rank, full * per, first, per))
                give(free - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if left and n:  # fewer items are left than the next container holds
                slots.append((length, rank, left, first, left))
                give(free - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            give(free, first, n)
    if zero := histogram.get(0, 0):
        slots.append((0, 0, zero, 0, zero))
        used = max(used, 1)
    return slots, used


def pack(items: DataFrame, containers: DataFrame, *, item_id: str = "doc_id", size: str = "n_tokens", kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """(kind, container_no, item_id, piece, start, n): every item in a container of every kind.

    An item is split only if it exceeds the capacity: into full containers and a rest that is
    packed like any item. start is the piece's first unit within the item. Items of size 0 or
    null share container 0 and take no room. Kinds with a null, zero or negative capacity get no
    items; item ids are expected to be unique, a repeated id is packed as often as it occurs.
    Empty items or containers give an empty result.
    """
    kinds = [(r[0], r[1]) for r in containers.select(kind, capacity).where(F.col(kind).isNotNull() & (F.col(capacity) > 0)).groupBy(kind).agg(F.max(capacity)).sort(kind).collect()]
    spark = items.sparkSession
    sized = cut_lineage(items.select(F.col(item_id).alias("_item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size")))
    # every item meets every kind: one pass over the items, however many kinds there are
    rooms = F.array(*[F.struct(F.lit(name).alias("_kind"), F.lit(room).cast("long").alias("_room")) for name, room in kinds]) if kinds else F.lit(None).cast("array<struct<_kind:string,_room:bigint>>")
    whole = F.floor((F.col("_size") - 1) / F.col("_room")).cast("int")  # pieces before the last
    start = F.col("_piece").cast("long") * F.col("_room")
    pieces = (
        sized.select("_item", "_size", F.inline(rooms))
        .select("_kind", "_room", "_item", "_size", F.explode(F.sequence(F.lit(0), F.greatest(whole, F.lit(0)))).alias("_piece"))
        .select("_kind", "_item", "_piece", start.alias("_start"), F.least("_room", F.col("_size") - start).alias("_length"))
    )

    # at most capacity + 1 rows per kind
    counts: dict[str, dict[int, int]] = {}
    for r in pieces.groupBy("_kind", "_length").count().collect():
        counts.setdefault(r["_kind"], {})[r["_length"]] = r["count"]
    rows, spread = [], []
    for name, room in kinds:
        slots, _ = plan_containers(counts.get(name, {}), room)
        rows += [(name, *s) for s in slots]
        spread += [(name, length, max(1, -(-n // BUCKET_ROWS))) for length, n in counts.get(name, {}).items()]
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["_kind", "_length", "_rank0", "_n", "_first", "_per"]).astype({"_kind": str} | dict.fromkeys(["_length", "_rank0", "_n", "_first", "_per"], "int64")), "_kind string, _length long, _rank0 long, _n long, _first long, _per long")
    buckets = spark.createDataFrame(pd.DataFrame(spread, columns=["_kind", "_length", "_buckets"]).astype({"_kind": str, "_length": "int64", "_buckets": "int64"}), "_kind string, _length long, _buckets long")

    keyed = pieces.join(buckets, ["_kind", "_length"]).withColumn("_bucket", F.pmod(F.xxhash64("_item", "_piece"), F.col("_buckets"))).drop("_buckets")
    part = ["_kind", "_length", "_bucket"]
    before = Window.partitionBy("_kind", "_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*part).agg(F.count(F.lit(1)).alias("_m")).withColumn("_offset", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*part).orderBy("_item", "_piece"))).join(offsets, part)
    ranked = ranked.withColumn("_rank", F.col("_offset") + F.col("_row") - 1).withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    blocks = plan.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_rank0") / BLOCK), F.floor((F.col("_rank0") + F.col("_n") - 1) / BLOCK))))
    placed = ranked.join(blocks, ["_kind", "_length", "_block"]).where("_rank >= _rank0 and _rank < _rank0 + _n")
    return placed.select(
        F.col("_kind").alias(kind),
        (F.col("_first") + F.floor((F.col("_rank") - F.col("_rank0")) / F.col("_per"))).cast("long").alias("container_no"),
        F.col("_item").alias(item_id),
        F.col("_piece").alias("piece"),
        F.col("_start").alias("start"),
        F.col("_length").alias("n"),
    )
