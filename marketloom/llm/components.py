"""Groups of records linked directly or indirectly.

Every node takes the minimum label among its neighbours, the pointers so made are jumped (to the
pointer of the pointer, twice), and the edges are contracted to where the pointers lead; the next
round works on what is left, until no label changes. A contracted graph is connected wherever the
graph was, so a round needs no pointers that have reached their roots. Each round writes its
pointers and its edges to the shared checkpoint folder. Contraction removes the edges inside a
finished group, so a group that owns a third of all edges is gone after a few rounds instead of
being joined again and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import clean_key, drop_written, write_out

#: Edges that may be left for one task to finish, about 10 MB of keys; more of them take another round.
LAST_EDGES = 20_000


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge: the minimum neighbour, jumped to its pointer's pointer twice.

    A label never exceeds its node, so pointers have no cycles.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("m")), F.struct(F.col("b").alias("node"), F.col("a").alias("m")))
    least = edges.select(F.inline(ends)).groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("root"))

    def jump(p: DataFrame) -> DataFrame:
        # one row per root on the right: AQE splits the rows of a busy root on the left
        return p.join(p.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").select("node", F.col("above").alias("root"))

    return jump(jump(least))


def _finish(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges in one task: the same minimum labels by union-find."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}

        def root(x: str) -> str:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up.setdefault(y, y)
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                x, y = root(a), root(b)
                if x != y:
                    # bytes, as Spark orders strings
                    lo, hi = (x, y) if x.encode() < y.encode() else (y, x)
                    up[hi] = lo
        yield pd.DataFrame({"node": list(up), "root": [root(x) for x in list(up)]}, dtype=str)

    return edges.coalesce(1).mapInPandas(run, "node string, root string")


def group_links(links: DataFrame, source: str, target: str, *, max_rounds: int = 100, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, group): every node of a link with both ends, and the smallest node of its group.

    Keys are compared without blanks around them. Links with an empty end are no links; repeated,
    reversed and self-links change nothing, a node named only by a self-link is its own group.
    Strings order by their bytes. Other columns are ignored. An empty table gives an empty result.
    From the second round on, no more than last_edges edges are finished by one task at once. The
    result is a table in the checkpoint folder; all others are removed.
    """
    spark = links.sparkSession
    ends = links.select(clean_key(source).alias("a"), clean_key(target).alias("b")).where("a is not null and b is not null")
    edges, path = write_out(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    paths, group, left = [path], None, None
    for number in range(max_rounds + 1):
        if left == 0:
            break
        if number == max_rounds:
            raise RuntimeError(f"labels still change after {max_rounds} rounds")
        last = left is not None and left <= last_edges
        pointers, path = write_out(_finish(edges) if last else _pointers(edges))
        paths.append(path)
        if group is None:
            group = pointers
        else:
            above = pointers.select(F.col("node").alias("root"), F.col("root").alias("above"))
            group = group.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        if last:
            break
        end = lambda c: pointers.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges, path = write_out(moved.where("a != b").distinct())
        paths.append(path)
        left = edges.count()
    result, _ = write_out(group.select("node", F.col("root").alias("group")))
    drop_written(spark, *paths)
    return result
