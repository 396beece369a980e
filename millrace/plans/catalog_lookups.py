"""Registered queries of the lookups and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lookups as L
from millrace.plans import bindings as B
from millrace.plans.catalog import query

T = B.table


@query(
    "unit_sets",
    """with s as (select l_partkey, list_sort(list(distinct l_suppkey)) as u, list_sort(list(distinct l_suppkey) filter (where l_returnflag = 'N')) as x from lineitem group by 1)
select l_partkey, cast(len(u) as int) as n_units, cast(coalesce(len(x), 0) as int) as n_exact, coalesce(array_to_string(x, ','), '') as exact_units from s""",
)
def unit_sets(spark, d):
    return L.unit_sets(T(spark, d, "lineitem"), "l_partkey", "l_suppkey", F.col("l_returnflag") == "N")


@query(
    "asof_next_error",
    """select event_id, first_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as later from events""",
)
def asof_next_error(spark, d):
    return L.next_at_or_after(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "event_id").select("event_id", "later")


@query(
    "nearest_extent",
    """with w as (select c_custkey, c_custkey % 40 + 1 as size, c_custkey * 3 as anchor from customer), e as (select p_size as size, p_partkey as place from part)
select c_custkey, place, distance from (select c_custkey, place, abs(place - anchor) as distance, row_number() over (partition by c_custkey order by abs(place - anchor), place) as rn from w join e on e.size = w.size) where rn = 1""",
)
def nearest_extent(spark, d):
    wants = T(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 40 + 1).alias("size"), (F.col("c_custkey") * 3).alias("anchor"))
    extents = T(spark, d, "part").select(F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("place"))
    return L.nearest(wants, "c_custkey", "size", "anchor", extents, "place", 500)


@query(
    "adjacent_rows",
    """with r as (select o_custkey, o_orderkey, o_orderkey % 9 as size, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders)
select o_orderkey, nxt - o_orderkey - size as gap, coalesce(nxt - o_orderkey - size between 0 and 1600, false) as adjacent from r""",
)
def adjacent_rows(spark, d):
    rows = T(spark, d, "orders").withColumn("size", F.col("o_orderkey") % 9)
    return L.adjacent(rows, "o_custkey", "o_orderkey", "size", 1600).select("o_orderkey", "gap", "adjacent")


@query(
    "lines_in_ranges",
    """with p as (select o_orderkey, o_custkey % 50 as g, o_orderkey % 1000 as x from orders), r as (select s_suppkey, s_suppkey % 50 as g, s_suppkey * 7 % 900 as lo, s_suppkey * 7 % 900 + 60 as hi from supplier)
select o_orderkey, s_suppkey from p join r on p.g = r.g and x between lo and hi""",
)
def lines_in_ranges(spark, d):
    points = T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("g"), (F.col("o_orderkey") % 1000).alias("x"))
    s = F.col("s_suppkey")
    ranges = T(spark, d, "supplier").select("s_suppkey", (s % 50).alias("g"), (s * 7 % 900).alias("lo"), (s * 7 % 900 + 60).alias("hi"))
    return L.in_ranges(points, "g", "x", ranges, "lo", "hi", "s_suppkey", 60).select("o_orderkey", "s_suppkey")


@query(
    "audit_reasons",
    """with r as (select c_custkey, concat_ws(',', case when c_acctbal < 0 then 'negative' end, case when c_mktsegment = 'BUILDING' then 'segment' end, case when c_nationkey % 2 = 0 then 'even' end) as reasons,
  cast((case when c_acctbal < 0 then 1 else 0 end) + (case when c_mktsegment = 'BUILDING' then 1 else 0 end) + (case when c_nationkey % 2 = 0 then 1 else 0 end) as int) as n_reasons from customer)
select *, case n_reasons when 0 then 'clean' when 1 then 'doubtful' else 'bad' end as status from r""",
)
def audit_reasons(spark, d):
    rules = {"negative": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "BUILDING", "even": F.col("c_nationkey") % 2 == 0}
    return L.reasons(T(spark, d, "customer"), rules).select("c_custkey", "reasons", "n_reasons", "status")


@query("lost_without_copy", f"with {B.SNAPSHOTS} select key from before_ where exact and key not in (select key from after_ where exact) and key not in (select o_orderkey from orders where o_orderstatus = 'F')")
def lost_without_copy(spark, d):
    copies = T(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return L.preserves_with_copies(B.snapshot(spark, d, "before"), B.snapshot(spark, d, "after"), "key", copies)


@query(
    "signed_deltas",
    """with n as (select o_custkey, o_orderpriority as p, sum(case when o_orderkey % 2 = 0 then 1 else -1 end) as delta from orders group by all having sum(case when o_orderkey % 2 = 0 then 1 else -1 end) <> 0)
select o_custkey, count(*) as n_items, cast(sum(delta * cast(left(p, 1) as int)) as bigint) as net_cost from n group by 1 having abs(sum(delta * cast(left(p, 1) as int))) <= 6""",
)
def signed_deltas(spark, d):
    o = T(spark, d, "orders")
    return L.signed_deltas(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int"), 6)


@query(
    "same_prefix",
    """with s as (select user_id, event_type, event_id % 2 as side, row_number() over (partition by user_id, event_id % 2 order by ts, event_id) as place from events),
j as (select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.place, b.place) as place, a.event_type as x, b.event_type as y from (select * from s where side = 0) a full join (select * from s where side = 1) b on a.user_id = b.user_id and a.place = b.place)
select user_id, count(x) as n_ours, count(y) as n_theirs, coalesce(min(case when x is distinct from y then place end) - 1, count(x)) as n_same from j group by 1 having count(x) > 0 and count(y) > 0""",
)
def same_prefix(spark, d):
    e = T(spark, d, "events")
    return L.same_prefix(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", ["ts", "event_id"], "event_type")
