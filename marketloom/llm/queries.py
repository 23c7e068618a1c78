"""Queries of the training-data problems 4, 5, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.components import group_links
from marketloom.llm.packing import pack
from marketloom.llm.sentences import sentences
from marketloom.llm.tokens import token_counts, token_ids
from marketloom.llm.topn import admissible_ranks, best_per_group
from marketloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, group_id): every segment of a whole link and the smallest of its group."""
    return group_links(table(spark, sf_dir, "returns_links"), "from_segment", "to_segment").select(F.col("node").alias("segment_id"), F.col("group").alias("group_id"))


P4_SQL = """
with recursive l as (
  select distinct trim(from_segment, ' ' || chr(9) || chr(10) || chr(13)) as a, trim(to_segment, ' ' || chr(9) || chr(10) || chr(13)) as b from returns_links),
e as (select a, b from l where a <> '' and b <> '' union select b, a from l where a <> '' and b <> ''),
reach as (select a, a as b from e union select r.a, e.b from reach r join e on r.b = e.a)
select a as segment_id, min(b) as group_id from reach group by a
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pool, selection_date, place, entity_id): the five best admissible entities of a selection."""
    ranks = admissible_ranks(table(spark, sf_dir, "univ1_pit_universe"))
    best = best_per_group(ranks, ["pool", "selection_date"], "rank", ["entity_id"], 5)
    return best.select("pool", F.date_format("selection_date", "yyyy-MM-dd").alias("selection_date"), "place", "entity_id")


P5_SQL = """
with r as (
  select *, row_number() over (partition by pool, selection_date, entity_id order by recorded_on desc, univ_id desc) as n
  from univ1_pit_universe where pool is not null and selection_date is not null and entity_id is not null),
a as (
  select pool, selection_date, entity_id, row_number() over (partition by pool, selection_date order by rank, entity_id) as place
  from r where n = 1 and upper(trim(status)) in ('MEMBER', 'ELIGIBLE_NOT_SELECTED') and rank >= 1 and not isnan(rank))
select pool, strftime(selection_date, '%Y-%m-%d') as selection_date, place::int as place, entity_id from a where place <= 5
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): token ids of every speech."""
    return token_ids(table(spark, sf_dir, "documents"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, container_no, doc_id, piece, start_token, n_tokens): every speech in containers of every kind."""
    packed = pack(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))
    return packed.withColumnsRenamed({"start": "start_token", "n": "n_tokens"})


def p9_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, n_containers, least_containers, n_tokens): containers used and the fewest that could do."""
    packed = p9_packing(spark, sf_dir)
    totals = packed.groupBy("container_kind").agg((F.max("container_no") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    kinds = table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens")
    return totals.join(kinds, "container_kind").select("container_kind", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "n_tokens")


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, documents, over_capacity, broken): what must hold of any packing.

    documents: documents placed; over_capacity: containers holding more than they may; broken:
    documents split although they fit, or whose pieces do not add up to one run from 0.
    """
    packed = p9_packing(spark, sf_dir).join(table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens"), "container_kind")
    docs = packed.groupBy("container_kind", "doc_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("size"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach")
    )
    by_doc = docs.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("size") != F.col("reach")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens"))))).alias("broken")
    )
    fill = packed.groupBy("container_kind", "container_no", "capacity_tokens").agg(F.sum("n_tokens").alias("held"))
    by_box = fill.groupBy("container_kind").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("over_capacity"))
    return by_doc.join(by_box, "container_kind").select("container_kind", "documents", "over_capacity", "broken")


P9_INVARIANTS_SQL = """
select container_kind, (select count(*) from documents) as documents, 0::bigint as over_capacity, 0::bigint as broken
from (select distinct container_kind from containers where container_kind is not null and capacity_tokens > 0) where exists (select 1 from documents)
"""


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_char, end_char): the sentences of every speech."""
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p8_ids, p9_packing, p9_utilisation, p9_invariants, p10_found)}
SQL = {"p4_found": P4_SQL, "p5_found": P5_SQL, "p9_invariants": P9_INVARIANTS_SQL}
