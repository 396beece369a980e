"""Relations of the driver's tables that stand in for evidence: snapshots, ledgers, bags and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Keyed snapshot (key, unit, score, exact, size): orders scored by their odd (before) or even (after) lines.

    A score is the share of lines flagged N; customers divisible by 50 have no size.
    """
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == (1 if side == "before" else 0))
    n = F.count(F.lit(1))
    flagged = F.count_if(F.col("l_returnflag") == "N")
    scores = lines.groupBy(F.col("l_orderkey").alias("key")).agg((F.lit(100.0) * flagged / n).alias("score"), (flagged == n).alias("exact"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("unit"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_totalprice")).alias("size"))
    return scores.join(orders, "key")


SNAPSHOTS = """
before_ as (
  select l_orderkey as key, o_custkey as unit, 100.0 * count(*) filter (where l_returnflag = 'N') / count(*) as score,
    count(*) filter (where l_returnflag = 'N') = count(*) as exact, case when o_custkey % 50 <> 0 then o_totalprice end as size
  from lineitem join orders on o_orderkey = l_orderkey where l_linenumber % 2 = 1 group by l_orderkey, o_custkey, o_totalprice
), after_ as (
  select l_orderkey as key, o_custkey as unit, 100.0 * count(*) filter (where l_returnflag = 'N') / count(*) as score,
    count(*) filter (where l_returnflag = 'N') = count(*) as exact, case when o_custkey % 50 <> 0 then o_totalprice end as size
  from lineitem join orders on o_orderkey = l_orderkey where l_linenumber % 2 = 0 group by l_orderkey, o_custkey, o_totalprice
)"""

CHANGES = (
    SNAPSHOTS
    + """, changes as (
  select coalesce(b.key, a.key) as key, coalesce(b.unit, a.unit) as unit, coalesce(a.size, b.size) as size, b.score as score_before, a.score as score_after,
    b.exact as exact_before, a.exact as exact_after, b.key is not null as in_before, a.key is not null as in_after,
    case when b.key is null then false when a.key is null then true
      else (b.exact and not a.exact) or coalesce(a.score, 0) < coalesce(b.score, 0) end as worse
  from before_ b full join after_ a on a.key = b.key
  where b.score is distinct from a.score or b.exact is distinct from a.exact
)"""
)


def customer_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, ours and theirs of the customer table: edits of every third and fifth key, deletions of some, the same edit on both sides of some."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    k = F.col("key")
    ours = base.where(k % 21 != 0).withColumn("nation", F.when(k % 3 == 0, F.col("nation") + 1).otherwise(F.col("nation")))
    theirs = base.where(k % 35 != 0).withColumn("nation", F.when(k % 30 == 0, F.col("nation") + 1).when(k % 5 == 0, F.col("nation") + 2).otherwise(F.col("nation")))
    return base, ours, theirs


MERGE = """
base as (select c_custkey as key, c_nationkey as nation, c_mktsegment as segment from customer),
ours as (select key, case when key % 3 = 0 then nation + 1 else nation end as nation, segment from base where key % 21 <> 0),
theirs as (select key, case when key % 30 = 0 then nation + 1 when key % 5 = 0 then nation + 2 else nation end as nation, segment from base where key % 35 <> 0),
m as (
  select b.key, b.nation as bn, o.nation as onat, t.nation as tn, o.key is not null as has_o, t.key is not null as has_t, b.segment
  from base b left join ours o using (key) left join theirs t using (key)
), f as (
  select *, has_o = has_t and onat is not distinct from tn as ot, has_t and bn = tn as bt, has_o and bn = onat as bo from m
), merged as (
  select key, case when ot or bt then onat when bo then tn end as nation,
    case when ((ot or bt) and has_o) or (not (ot or bt) and bo and has_t) then segment end as segment,
    case when not ot and not bt and not bo then 'conflict' when ((ot or bt) and not has_o) or (bo and not bt and not has_t) then 'deleted'
      when bo and bt then 'same' when ot then 'both' when bt then 'ours' else 'theirs' end as status
  from f
)"""
