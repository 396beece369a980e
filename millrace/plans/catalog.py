"""Registered queries over the driver's tables, one for each operator family, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import align, alignment, bags, graphs, intervals, inventories, ordered, records, snapshots, votes
from millrace.plans import bindings as B
from millrace.plans.alignment_sql import BLOCKS

T = B.table
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return B.snapshot(spark, d, "before"), B.snapshot(spark, d, "after")


# --- snapshots ---------------------------------------------------------------------------------


@query("snapshot_compare", f"with {B.CHANGES} select key, unit, score_before, score_after, worse from changes")
def snapshot_compare(spark, d):
    c = snapshots.compare(*_both(spark, d), "key")
    return c.select("key", F.coalesce("unit_before", "unit_after").alias("unit"), "score_before", "score_after", "worse")


@query(
    "net_gate",
    f"""with {B.CHANGES}, g as (
  select unit, count(*) as n_changed, count(*) filter (where worse) as n_worse, count(*) filter (where size is null) as n_unsized,
    count(*) filter (where worse and coalesce(exact_before, false) and not coalesce(exact_after, false)) as n_lost,
    sum(cast(size as decimal(20,2)) * cast(coalesce(score_after, 0) - coalesce(score_before, 0) as decimal(18,9))) as net
  from changes group by unit
) select unit, n_changed, n_worse, cast(net as double) as net,
  case when n_worse = 0 then 'no loss' when n_unsized > 0 then 'unsized' when n_lost > 0 then 'lost exact' when coalesce(net, 0) <= 0 then 'net not positive' else 'net positive' end as reason,
  n_worse = 0 or (n_unsized = 0 and n_lost = 0 and coalesce(net, 0) > 0) as accepted from g""",
)
def net_gate(spark, d):
    g = snapshots.net_gate(snapshots.compare(*_both(spark, d), "key"))
    return g.select("unit", "n_changed", "n_worse", F.col("net").cast("double").alias("net"), "reason", "accepted")


@query("lowered_scores", f"with {B.SNAPSHOTS} select b.key, b.score as score_before, coalesce(a.score, 0.0) as score_after from before_ b left join after_ a using (key) where coalesce(a.score, 0) < b.score")
def lowered_scores(spark, d):
    return snapshots.lowered(*_both(spark, d), "key")


@query(
    "net_gain",
    f"""with {B.SNAPSHOTS} select b.unit, cast(sum(cast(b.size as decimal(20,2)) * cast(coalesce(a.score, 0) - b.score as decimal(18,9))) as double) as gain, count(*) as n_keys
from before_ b left join after_ a using (key) group by b.unit""",
)
def net_gain(spark, d):
    return snapshots.net_gain(*_both(spark, d), "key").withColumn("gain", F.col("gain").cast("double"))


@query(
    "regressed_keys",
    f"""with {B.SNAPSHOTS} select * from (select b.key, b.unit, case when a.key is null then 'missing' when b.exact and not a.exact then 'lost' when a.score < b.score then 'lower' end as how
from before_ b left join after_ a using (key)) where how is not null""",
)
def regressed_keys(spark, d):
    return snapshots.regressed(*_both(spark, d), "key")


@query("worse_units", f"with {B.SNAPSHOTS} select distinct b.unit from before_ b left join after_ a using (key) where a.key is null or a.score < b.score or (b.exact and not a.exact)")
def worse_units(spark, d):
    return snapshots.regressed(*_both(spark, d), "key").select("unit").distinct()


@query(
    "moved_rows",
    f"""with {B.SNAPSHOTS} select key, b.unit, a.score - b.score as delta from before_ b join after_ a using (key) where abs(a.score - b.score) > 25 or a.exact <> b.exact""",
)
def moved_rows(spark, d):
    return snapshots.moved(*_both(spark, d), "key", 25.0).select("key", F.col("unit_before").alias("unit"), "delta")


@query(
    "target_holds",
    f"""with {B.SNAPSHOTS}, m as (select key, b.unit, a.score - b.score as delta, b.exact and not a.exact as lost from before_ b join after_ a using (key) where abs(a.score - b.score) > 25 or a.exact <> b.exact)
select unit, bool_or(key % 2 = 0 and delta > 0) as raised, count(*) filter (where delta < 0 or lost) as n_broken, bool_or(key % 2 = 0 and delta > 0) and count(*) filter (where delta < 0 or lost) = 0 as holds from m group by unit""",
)
def target_holds(spark, d):
    return snapshots.holds(snapshots.moved(*_both(spark, d), "key", 25.0), F.col("key") % 2 == 0)


@query(
    "exact_delta",
    f"""with {B.SNAPSHOTS} select b.unit, count(*) filter (where b.exact and not coalesce(a.exact, false)) as n_lost, count(*) filter (where not b.exact and coalesce(a.exact, false)) as n_gained,
  count(*) filter (where a.key is not null and a.score <> b.score) as n_rescored from before_ b left join after_ a using (key) group by b.unit""",
)
def exact_delta(spark, d):
    return snapshots.exact_delta(*_both(spark, d), "key")


@query(
    "unit_preserves",
    f"""with {B.SNAPSHOTS} select b.unit, not bool_or(b.exact and not coalesce(a.exact, false)) as keeps_exact, not bool_or(coalesce(a.score, 0) < b.score) as keeps_scores, bool_and(a.key is not null) as keeps_keys
from before_ b left join after_ a using (key) group by b.unit""",
)
def unit_preserves(spark, d):
    return snapshots.preserves(*_both(spark, d), "key")


@query("three_way_merge", f"with {B.MERGE} select key, nation, segment, status from merged")
def three_way_merge(spark, d):
    return snapshots.three_way_merge(*B.customer_versions(spark, d), "key", ["nation", "segment"])


@query(
    "address_clash",
    f"with {B.MERGE} select nation, count(distinct key) as n_keys, min(key) as first_key from merged where nation is not null and status <> 'conflict' group by nation having count(distinct key) > 1",
)
def address_clash(spark, d):
    merged = snapshots.three_way_merge(*B.customer_versions(spark, d), "key", ["nation", "segment"])
    return snapshots.clashes(merged.where("status <> 'conflict'"), "nation", "key")


# --- ledgers, votes and rankings ---------------------------------------------------------------


@query(
    "ledger_argmax",
    """select user_id, event_type, event_id, gain from (select *, floor(value / 50) as gain, row_number() over (partition by user_id, event_type order by floor(value / 50) desc, event_id) as rn from events where floor(value / 50) > 0) where rn = 1""",
)
def ledger_argmax(spark, d):
    return votes.best_per_group(T(spark, d, "events"), ["user_id", "event_type"], F.floor(F.col("value") / 50).cast("double"), "event_id").select("user_id", "event_type", "event_id", "gain")


@query("ledger_resume", "select distinct user_id from events where user_id not in (select user_id from events where event_type = 'error' and floor(value / 20) = 3)")
def ledger_resume(spark, d):
    log = T(spark, d, "events").withColumn("level", F.floor(F.col("value") / 20).cast("long"))
    return votes.unseen(log.select("user_id").distinct(), log, "user_id", {"event_type": "error", "level": 3})


@query(
    "mode_first",
    """with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all)
select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, f) as rn from c) where rn = 1""",
)
def mode_first(spark, d):
    return votes.mode_first(T(spark, d, "events"), "user_id", "event_type", "event_id")


@query(
    "vote_ambiguous",
    """with t as (select o_custkey, o_orderpriority, sum(case when o_orderstatus = 'F' then 2 else 1 end) as votes from orders group by all),
b as (select o_custkey, max(votes) as votes from t group by all)
select b.o_custkey, case when count(*) = 1 then min(o_orderpriority) end as winner, cast(b.votes as bigint) as votes, count(*) > 1 as ambiguous from t join b on t.o_custkey = b.o_custkey and t.votes = b.votes group by b.o_custkey, b.votes""",
)
def vote_ambiguous(spark, d):
    return votes.weighted_vote(T(spark, d, "orders"), "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 2).otherwise(1))


@query(
    "unanimous_claim",
    """with a as (select l_orderkey, min(l_partkey) as claim, count(*) as n_sites from lineitem group by 1 having count(distinct l_partkey) = 1)
select l_orderkey, claim, n_sites, count(*) over (partition by claim) = 1 as proven from a""",
)
def unanimous_claim(spark, d):
    return votes.unanimous(T(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query(
    "rank_multivalue",
    """select key, count(*) as n_rows, cast(sum(n_chars) as bigint) as total from (select doc_id, n_chars, unnest(list_distinct(string_split(text, ' '))) as key from documents) group by key""",
)
def rank_multivalue(spark, d):
    return votes.rank_multivalue(T(spark, d, "documents"), F.split("text", " "), "n_chars")


@query(
    "cause_alone",
    """with s as (select l_orderkey, list(distinct l_returnflag) as fs from lineitem group by 1)
select l_returnflag, count(*) as n_blocked, count(*) filter (where len(fs) = 1) as n_alone from (select unnest(fs) as l_returnflag, fs from s) group by 1""",
)
def cause_alone(spark, d):
    return votes.blocking(T(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query(
    "construct_rank",
    """with o as (select l_partkey, l_orderkey, count(*) as n, max(cast(l_quantity as bigint)) as size from lineitem group by all)
select l_partkey, cast(sum(n) as bigint) as n_sites, count(*) as n_functions, cast(sum(size) as bigint) as total_size from o group by 1""",
)
def construct_rank(spark, d):
    return votes.construct_rank(T(spark, d, "lineitem").withColumn("size", F.col("l_quantity").cast("long")), "l_partkey", "l_orderkey", "size")


@query(
    "exact_sets",
    """with p as (select l_partkey, month(l_shipdate) as m, bool_and(l_returnflag = 'N') as exact from lineitem group by all),
s as (select l_partkey, count(*) filter (where exact) as n_exact, coalesce(bool_or(exact and m = 1), false) as at_base from p group by 1)
select l_partkey, n_exact, at_base, case when n_exact = 0 then 'never' when not at_base then 'locked' when n_exact < 12 then 'witness' else 'always' end as kind from s""",
)
def exact_sets(spark, d):
    rows = T(spark, d, "lineitem").withColumn("month", F.month("l_shipdate"))
    return votes.exact_sets(rows, "l_partkey", "month", F.col("l_returnflag") == "N", F.col("month") == 1, 12)


@query(
    "variant_audit",
    """with f as (select l_quantity >= 10 as base, l_quantity >= 20 as q20, l_quantity >= 5 as q5, l_discount >= 0.05 as d5 from lineitem)
select v as variant, n_exact, n_lost, n_gained from (
  select 'base' as v, count(*) filter (where base) as n_exact, 0::bigint as n_lost, 0::bigint as n_gained from f
  union all select 'q20', count(*) filter (where q20), count(*) filter (where base and not q20), count(*) filter (where not base and q20) from f
  union all select 'q5', count(*) filter (where q5), count(*) filter (where base and not q5), count(*) filter (where not base and q5) from f
  union all select 'd5', count(*) filter (where d5), count(*) filter (where base and not d5), count(*) filter (where not base and d5) from f)""",
)
def variant_audit(spark, d):
    q = F.col("l_quantity")
    return votes.variant_audit(T(spark, d, "lineitem"), "l_orderkey", {"base": q >= 10, "q20": q >= 20, "q5": q >= 5, "d5": F.col("l_discount") >= 0.05}, "base")


@query(
    "bench_table",
    """select event_type, count(*) as n_cases, count(*) filter (where value >= 100) as n_solved, avg(cast(floor(value) as bigint)) as mean_cost, avg(cast(floor(value) as bigint)) filter (where value >= 100) as mean_solved_cost from events group by 1""",
)
def bench_table(spark, d):
    return votes.bench_table(T(spark, d, "events"), "event_type", F.col("value") >= 100, F.floor("value").cast("long"))


@query(
    "location_table",
    """with e as (select event_type, cast(floor(value) as bigint) % 7 as dist, cast(floor(value) as bigint) as v from events)
select event_type, count(*) filter (where dist < 6) as n_pointed, count(*) filter (where dist = 0) as n_on_line, count(*) filter (where dist <= 2) as n_within_two, avg(v) as mean_share from e group by 1""",
)
def location_table(spark, d):
    v = F.floor("value").cast("long")
    return votes.location_table(T(spark, d, "events"), "event_type", F.when(v % 7 < 6, v % 7), v)


@query(
    "capped_sample",
    """select o_orderpriority, o_orderkey, rank from (select *, row_number() over (partition by o_orderpriority order by md5('7' || o_orderkey), o_orderkey) as rank from orders) where rank <= 20""",
)
def capped_sample(spark, d):
    return votes.capped_sample(T(spark, d, "orders"), "o_orderpriority", "o_orderkey", 20, "7").select("o_orderpriority", "o_orderkey", "rank")


# --- bags ----------------------------------------------------------------------------------------


@query(
    "bag_difference",
    """select event_type, greatest(o - t, 0) as ours_only, greatest(t - o, 0) as theirs_only from (select event_type, count(*) filter (where user_id % 2 = 1) as o, count(*) filter (where user_id % 2 = 0) as t from events group by 1) where o <> t""",
)
def bag_difference(spark, d):
    e = T(spark, d, "events")
    return bags.difference(e.where("user_id % 2 = 1"), e.where("user_id % 2 = 0"), ["event_type"])


def _cancel_sides(spark, d):
    lines = T(spark, d, "lineitem").join(T(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # lines have no key of their own: equal rows are interchangeable, so a hash of the row orders them
    rows = lines.select("l_partkey", F.col("p_brand").alias("brand"), "l_suppkey", F.col("l_orderkey").alias("ord"), "l_linenumber")
    return rows.where("l_suppkey % 2 = 1"), rows.where("l_suppkey % 2 = 0")


@query(
    "two_stage_cancel",
    """with l as (select l_partkey, p_brand as brand, l_suppkey % 2 = 1 as odd from lineitem join part on p_partkey = l_partkey),
p as (select l_partkey, brand, count(*) filter (where odd) as o, count(*) filter (where not odd) as t from l group by all),
b as (select brand, sum(greatest(o - t, 0)) as o, sum(greatest(t - o, 0)) as t from p group by 1)
select * from (select 'ours' as side, brand, cast(greatest(o - t, 0) as bigint) as n_left from b union all select 'theirs', brand, cast(greatest(t - o, 0) as bigint) from b) where n_left > 0""",
)
def two_stage_cancel(spark, d):
    ours, theirs = bags.cancel(*_cancel_sides(spark, d), ["l_partkey", "brand"], "ord")
    left = ours.select(F.lit("ours").alias("side"), "brand").union(theirs.select(F.lit("theirs"), "brand"))
    return left.groupBy("side", "brand").agg(F.count(F.lit(1)).alias("n_left"))


@query(
    "overflow_pairs",
    """with o as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as ordinal from orders where o_orderstatus = 'F'),
t as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as ordinal from orders where o_orderstatus = 'O')
select o_orderpriority, ordinal, o.o_orderkey as ours, t.o_orderkey as theirs from o full join t using (o_orderpriority, ordinal)""",
)
def overflow_pairs(spark, d):
    o = T(spark, d, "orders")
    return bags.pair(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_orderpriority", "o_orderkey")


_BOUGHT = "select distinct c_nationkey, l_partkey from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where month(l_shipdate) "


@query(
    "set_symdiff_by_base",
    f"""with o as ({_BOUGHT} <= 6), t as ({_BOUGHT} > 6)
select c_nationkey, count(o1) as n_ours, count(t1) as n_theirs, count(*) filter (where t1 is null) as ours_only, count(*) filter (where o1 is null) as theirs_only
from (select c_nationkey, l_partkey, 1 as o1 from o) full join (select c_nationkey, l_partkey, 1 as t1 from t) using (c_nationkey, l_partkey) group by 1
having count(o1) > 0 and count(t1) > 0 and count(*) filter (where t1 is null or o1 is null) > 0""",
)
def set_symdiff_by_base(spark, d):
    rows = T(spark, d, "lineitem").join(T(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(T(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.select("c_nationkey", "l_partkey", F.month("l_shipdate").alias("month"))
    return bags.symmetric_difference(rows.where("month <= 6"), rows.where("month > 6"), "c_nationkey", "l_partkey")


@query("twin_filter", "select distinct l_orderkey from lineitem where l_orderkey - 1 not in (select l_orderkey from lineitem)")
def twin_filter(spark, d):
    return bags.without_twins(T(spark, d, "lineitem").select("l_orderkey").distinct(), "l_orderkey", F.col("l_orderkey") - 1)


@query("first_seen_distinct", "select min(doc_id) as doc_id, count(*) as n_copies from documents group by text")
def first_seen_distinct(spark, d):
    return bags.distinct_first(T(spark, d, "documents"), "text", "doc_id").select("doc_id", "n_copies")


@query(
    "same_bag",
    """with c as (select o_custkey, o_orderpriority, count(*) filter (where o_orderkey % 2 = 0) as a, count(*) filter (where o_orderkey % 2 = 1) as b from orders group by all)
select o_custkey, bool_and(a = b) as same, cast(sum(a) as bigint) as n_ours, cast(sum(b) as bigint) as n_theirs from c group by 1 having sum(a) > 0 and sum(b) > 0""",
)
def same_bag(spark, d):
    o = T(spark, d, "orders")
    return bags.same_bag(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderpriority")


@query(
    "edge_delta",
    """with c as (select event_type, user_id, count(*) filter (where event_id % 2 = 0) as b, count(*) filter (where event_id % 2 = 1) as a from events group by all)
select event_type, user_id, greatest(b - a, 0) as ours_only, greatest(a - b, 0) as theirs_only from c where a <> b""",
)
def edge_delta(spark, d):
    e = T(spark, d, "events")
    return bags.difference(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["event_type", "user_id"])


# --- ordered rows --------------------------------------------------------------------------------


@query(
    "asof_last_error",
    """select event_id, user_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as earlier from events""",
)
def asof_last_error(spark, d):
    return ordered.asof_last(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "event_id").select("event_id", "user_id", "earlier")


@query(
    "next_span",
    """select o_orderkey, o_custkey, coalesce(lead(epoch_us(o_orderdate) // 86400000000) over (partition by o_custkey order by o_orderdate, o_orderkey), 4611686018427387904) as span_end from orders""",
)
def next_span(spark, d):
    rows = T(spark, d, "orders").withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")).cast("long"))
    return ordered.next_span(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "day", F.lit(1 << 62)).select("o_orderkey", "o_custkey", "span_end")


@query(
    "islands",
    """with u as (select distinct user_id, cast(ts as date) - date '1970-01-01' as n from events), i as (select user_id, n, n - row_number() over (partition by user_id order by n) as g from u),
r as (select user_id, min(n) as f, max(n) as l, count(*) as len from i group by user_id, g)
select user_id, string_agg(case when f = l then cast(f as varchar) else f || '-' || l end, ', ' order by f) as spans, count(*) as n_islands, max(len) as longest from r group by 1""",
)
def islands(spark, d):
    found = ordered.islands(T(spark, d, "events"), "user_id", F.unix_date(F.col("ts").cast("date")))
    return ordered.spans_text(found, "user_id")


@query(
    "continuity_check",
    """with c as (select conv_id, turn + case when turn >= conv_id % 5 then conv_id % 3 else 0 end as turn from conversations)
select * from (select conv_id, turn, coalesce(lag(turn) over (partition by conv_id order by turn) + 1, 0) as expected from c) where turn <> expected""",
)
def continuity_check(spark, d):
    """Conversations whose numbering leaves out up to two turns from some place on: where it isn't continuous."""
    k = F.col("conv_id")
    turns = T(spark, d, "conversations").select("conv_id", (F.col("turn") + F.when(F.col("turn") >= k % 5, k % 3).otherwise(0)).alias("turn"))
    return ordered.continuity(turns, "conv_id", "turn").select("conv_id", "turn", "expected")


@query(
    "since_reset",
    """with s as (select *, coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as session from events)
select user_id, cast(session as bigint) as session, event_type, count(*) as n from s group by all""",
)
def since_reset(spark, d):
    rows = ordered.since_reset(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id", "session", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "running_budget",
    """with r as (select event_id, user_id, ts, sum(cast(floor(value) as bigint) - 100) over (partition by user_id order by ts, event_id rows unbounded preceding) as running from events),
m as (select *, min(running) over (partition by user_id order by ts, event_id rows unbounded preceding) as lowest from r)
select event_id, cast(running as bigint) as running, cast(lowest as bigint) as lowest, running > floor(cast(lowest as double) / 2) as over_limit from m""",
)
def running_budget(spark, d):
    rows = ordered.running_budget(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.floor("value") - 100)
    return rows.select("event_id", "running", "lowest", (F.col("running") > F.floor(F.col("lowest") / 2)).alias("over_limit"))


_HISTORY = "select o_custkey, o_orderkey, o_orderdate, lag(o_orderstatus) over w as previous, o_orderstatus as value, row_number() over w as n from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"


@query("change_history", f"select o_custkey, o_orderkey, previous, value from ({_HISTORY}) where n > 1 and previous is distinct from value")
def change_history(spark, d):
    rows = T(spark, d, "orders").withColumn("value", F.col("o_orderstatus"))
    return ordered.change_history(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "value").select("o_custkey", "o_orderkey", "previous", "value")


@query(
    "first_last_change",
    f"""select o_custkey, min(ord) as first_at, max(ord) as last_at, count(*) as n_changes from (select o_custkey, n as ord from ({_HISTORY}) where n > 1 and previous is distinct from value) group by 1""",
)
def first_last_change(spark, d):
    rows = T(spark, d, "orders").withColumn("value", F.col("o_orderstatus"))
    changes = ordered.change_history(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "value")
    return ordered.decisions(changes, "o_custkey", "ordinal").select("o_custkey", F.col("first.ordinal").cast("long").alias("first_at"), F.col("last.ordinal").cast("long").alias("last_at"), "n_changes")


@query(
    "sequence_pieces",
    """with s as (select user_id, event_id, coalesce(sum(case when event_type in ('click', 'error') then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as piece from events)
select user_id, cast(piece as bigint) as piece, count(*) as n, min(event_id) as low, max(event_id) as high from s group by all""",
)
def sequence_pieces(spark, d):
    rows = ordered.pieces(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("click", "error"))
    return rows.groupBy("user_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@query(
    "look_ahead",
    """select event_id, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 1 following and 8 following), 0) = 1 as follows from events""",
)
def look_ahead(spark, d):
    return ordered.look_ahead(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 8).select("event_id", "follows")


_STATUS = ["F", "O", "F"]


@query(
    "size_run_match",
    """with p as (select o_custkey, o_orderstatus as v, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders),
w(i, want) as (values (0, 'F'), (1, 'O'), (2, 'F')),
s as (select o_custkey, pos - i as start, count(*) as score from p join w on v = want group by o_custkey, pos - i having pos - i >= 1 and 2 * count(*) > 3)
select o_custkey, start, score from (select *, row_number() over (partition by o_custkey order by score desc, start) as rn from s) where rn = 1""",
)
def size_run_match(spark, d):
    return ordered.size_runs(T(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", _STATUS)


# --- intervals -----------------------------------------------------------------------------------


@query(
    "range_owner_unique",
    """select c_custkey, count(s_suppkey) as n_owners, case when count(s_suppkey) = 1 then min(s_suppkey) end as owner
from customer left join supplier on c_acctbal >= s_acctbal - 50 and c_acctbal < s_acctbal + 50 group by 1""",
)
def range_owner_unique(spark, d):
    ranges = T(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 50).alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return intervals.owners(T(spark, d, "customer"), "c_acctbal", "c_custkey", ranges, "low", "high", "s_suppkey").select("c_custkey", "n_owners", "owner")


def _ranges(spark, d, parity):
    lines = T(spark, d, "lineitem").where(F.col("l_linenumber") % 2 == parity).groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    rows = T(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    a, b = day("o_orderdate"), day("ship")
    return rows.select("o_custkey", F.least(a, b).alias("start"), (F.greatest(a, b) + 1).alias("end"))


_DAYS = """select distinct o_custkey, unnest(range(least(a, b), greatest(a, b) + 1)) as day from (
  select o_custkey, epoch_us(o_orderdate) // 86400000000 as a, (select max(epoch_us(l_shipdate)) // 86400000000 from lineitem where l_orderkey = o_orderkey and l_linenumber % 2 = {p}) as b from orders) where b is not null"""


@query(
    "interval_overlap",
    f"""with x as ({_DAYS.format(p=1)}), y as ({_DAYS.format(p=0)})
select o_custkey, count(i) as covered_before, count(j) as covered_after, count(*) filter (where j is null) as lost, count(*) filter (where i is null) as gained
from (select o_custkey, day, 1 as i from x) full join (select o_custkey, day, 1 as j from y) using (o_custkey, day) group by 1""",
)
def interval_overlap(spark, d):
    a, b = (intervals.merged(_ranges(spark, d, p), "o_custkey", "start", "end") for p in (1, 0))
    return intervals.lost_and_gained(a, b, "o_custkey")


@query(
    "smallest_enclosing",
    """with p as (select o_orderkey, o_custkey % 20 as g, cast(floor(o_totalprice / 1000) as bigint) as x from orders),
r as (select p_partkey, p_partkey % 20 as g, p_size * 5 as lo, p_size * 5 + cast(p_partkey % 97 as int) as hi from part)
select o_orderkey, arg_min(p_partkey, (hi - lo) * 1000000 + p_partkey) as p_partkey, min(hi - lo) as length from p join r on p.g = r.g and lo <= x and x <= hi group by 1""",
)
def smallest_enclosing(spark, d):
    points = T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("g"), F.floor(F.col("o_totalprice") / 1000).alias("x"))
    ranges = T(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 20).alias("g"), (F.col("p_size") * 5).alias("lo"), (F.col("p_size") * 5 + (F.col("p_partkey") % 97).cast("int")).alias("hi"))
    order = (F.col("hi") - F.col("lo")) * 1_000_000 + F.col("p_partkey")  # the SQL's: keys beyond a million weigh more than a length
    return intervals.smallest_enclosing(points, "x", "g", "o_orderkey", ranges, "lo", "hi", "p_partkey", order)


# --- graphs --------------------------------------------------------------------------------------


@query(
    "closure",
    """with recursive m as (select count(*) as m from supplier), e as (select s_suppkey as s, (7 * s_suppkey + 3) % m as t from supplier, m union select s_suppkey, (s_suppkey * s_suppkey + 1) % m from supplier, m),
r(node) as (select 1::bigint union select e.t from r join e on e.s = r.node) select node from r""",
)
def closure(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey")
    m = s.agg(F.count(F.lit(1)).alias("m"))
    k = F.col("s_suppkey")
    rows = s.join(F.broadcast(m))  # m is one row
    edges = rows.select(k.alias("source"), F.explode(F.array((7 * k + 3) % F.col("m"), (k * k + 1) % F.col("m"))).alias("target"))
    return graphs.closure(edges.distinct(), spark.range(1, 2).select(F.col("id").alias("node"))).select("node")


@query(
    "fixpoint_components",
    """with recursive e as (select distinct l_orderkey, l_partkey from lineitem), f as (select l_orderkey, min(l_partkey) as root from e group by 1),
x as (select l_partkey as a, root as b from e join f using (l_orderkey) where l_partkey <> root), y as (select a, b from x union select b, a from x),
r(node, label) using key (node) as (select distinct l_partkey, l_partkey from e
  union select y.b, min(r.label) from r join y on y.a = r.node join recurring.r as k on k.node = y.b where r.label < k.label group by y.b)
select node, label from r""",
)
def fixpoint_components(spark, d):
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    # parts of one order are linked through the order's smallest part: the same components with one edge per part
    first = rows.groupBy("l_orderkey").agg(F.min("l_partkey").alias("target"))
    edges = rows.join(first, "l_orderkey").select(F.col("l_partkey").alias("source"), "target")
    return graphs.components(edges, rows.select(F.col("l_partkey").alias("node")))


@query(
    "single_chains",
    """with recursive e as (select distinct s_suppkey as s, (s_suppkey * 3 + s_nationkey) // 4 as t from supplier),
o as (select s, count(*) as n, min(t) as t from e group by 1),
r(node, cur, path) as (select s, s, [s] from e union all select r.node, o.t, list_append(path, o.t) from r join o on o.s = r.cur where o.n = 1 and not list_contains(path, o.t))
select node, cur as "end", cast(len(path) - 1 as int) as length, case when o.n is null then 'end' when o.n > 1 then 'ambiguous' else 'cycle' end as why
from r left join o on o.s = r.cur where o.n is null or o.n > 1 or list_contains(path, o.t)""",
)
def single_chains(spark, d):
    s = T(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("source"), F.expr("(s_suppkey * 3 + s_nationkey) div 4").alias("target")).distinct()
    return graphs.single_chains(edges, s.select(F.col("s_suppkey").alias("node")))


# --- text ----------------------------------------------------------------------------------------

RULES = [(r"error|Error", "error"), (r"<h1>([^<]*)</h1>", "title {1}"), (r"(?i)<table", "table"), (r"/([a-z]+)/", "path {1}")]


@query(
    "rule_cascade",
    r"""with m as (select page_id, url || ' ' || html as t from pages)
select case when regexp_matches(t, 'error|Error') then 'error' when regexp_matches(t, '<h1>([^<]*)</h1>') then 'title ' || regexp_extract(t, '<h1>([^<]*)</h1>', 1)
  when regexp_matches(t, '(?i)<table') then 'table' when regexp_matches(t, '/([a-z]+)/') then 'path ' || regexp_extract(t, '/([a-z]+)/', 1) else substring(regexp_replace(t, '''[^'']*''', 'X', 'g'), 1, 80) end as cause, page_id from m""",
)
def rule_cascade(spark, d):
    text = F.concat_ws(" ", "url", "html")
    return T(spark, d, "pages").select("page_id", X.cause(text, RULES).alias("cause"))


@query(
    "agree_level",
    """with p as (select a.doc_id as a, b.doc_id as b, a.text as x, b.text as y from documents a join documents b on left(a.text, 20) = left(b.text, 20) and a.doc_id < b.doc_id)
select level, count(*) as n_pairs from (select case when x = y then 'exact' when left(x, 60) = left(y, 60) then 'prefix 60' else 'prefix 20' end as level from p) group by 1""",
)
def agree_level(spark, d):
    text = F.col("text")
    return align.agreeing_pairs(T(spark, d, "documents"), [("exact", F.sha2(text, 256)), ("prefix 60", F.substring(text, 1, 60)), ("prefix 20", F.substring(text, 1, 20))])


@query(
    "align_documents",
    f"""with recursive d as (select doc_id as key, string_split(text, ' ') as a from documents), seqs as (select x.key, x.a, y.a as b from d x join d y on y.key = x.key + 1), {BLOCKS},
s as (select key, sum(n) as eq, sum(case when i2 > i1 and j2 > j1 then greatest(i2 - i1, j2 - j1) else 0 end) as rep, sum(case when j2 = j1 then i2 - i1 else 0 end) as del, sum(case when i2 = i1 then j2 - j1 else 0 end) as ins, min(case when i2 > i1 or j2 > j1 then i1 end) as first, max(i2) + max(j2) as total from gaps group by key)
select key as doc_id, case when total = 0 then 100.0 else round_even(200.0 * eq / total, 2) end as score, cast(eq as int) as n_equal, cast(rep as int) as n_replaced, cast(del as int) as n_deleted, cast(ins as int) as n_inserted, cast(coalesce(first, -1) as int) as first_difference from s""",
)
def align_documents(spark, d):
    """Each document against its successor by id: score and opcode counts of the token alignment."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    joined = docs.join(other, "doc_id")  # texts are shuffled, not their larger arrays of tokens
    return alignment.align(joined, "doc_id", F.split("text", " "), F.split("other", " "))


@query(
    "longest_common_block",
    """with d as (select doc_id, string_split(text, ' ') as w from documents), t as (select doc_id, unnest(w) as w, unnest(range(len(w))) as p from d),
c as (select a.doc_id, a.p as i, b.p as j, a.p - row_number() over (partition by a.doc_id, a.p - b.p order by a.p) as run from t a join t b on b.doc_id = a.doc_id + 1 and b.w = a.w),
r as (select doc_id, min(i) as i, min(j) as j, count(*) as size from c group by doc_id, i - j, run)
select doc_id, cast(i as int) as i, cast(j as int) as j, cast(size as int) as size from (select *, row_number() over (partition by doc_id order by size desc, i, j) as k from r) where k = 1""",
)
def longest_common_block(spark, d):
    """The longest run of words that each document and its successor by id share."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return alignment.longest(docs.join(other, "doc_id"), "doc_id", F.split("text", " "), F.split("other", " "))


@query(
    "rewrite_udtf",
    """with t as (select conv_id * 1000 + turn as key, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) as l from conversations), e as (select key, l, unnest(range(1, len(l))) as i from t where len(l) > 1),
r as (select key, 'swap' as kind, i, list_concat(list_concat(l[1:i - 1], [l[i + 1], l[i]]), l[i + 2:]) as m from e where l[i] <> l[i + 1] union all select key, 'join', i, list_concat(list_concat(l[1:i - 1], [l[i] || ' ' || l[i + 1]]), l[i + 2:]) from e)
select key, kind, cast(i - 1 as int) as line, sha256(array_to_string(m, chr(10))) as digest from r""",
)
def rewrite_udtf(spark, d):
    """0..n rewrites of each conversation turn, by digest."""
    turns = T(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    return align.rewrites(turns, "key", "text").select("key", "kind", "line", F.sha2("result", 256).alias("digest"))


# --- residual and reconciliation -------------------------------------------------------------------


@query(
    "residual_rollup",
    """with o as (select l_orderkey, l_returnflag as kind, count(*) as n, min(l_quantity) as low from lineitem group by l_orderkey, l_linenumber % 2, l_returnflag),
k as (select l_orderkey, kind, max(n) as n, min(low) as low from o group by all)
select l_orderkey, cast(sum(n) as bigint) as n_rows, min(low) as score, string_agg(kind, ',' order by kind) as kinds,
  case when bool_or(kind = 'N') then 'source' when bool_and(kind = 'A') then 'no source' else 'other' end as "group" from k group by 1""",
)
def residual_rollup(spark, d):
    """Occurrences (an order's odd and even lines) to groups: rows of a kind are the most of any occurrence, the score the least."""
    occurrence = T(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("side"), F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"))
    kinds = occurrence.groupBy("l_orderkey", "kind").agg(F.max("n").alias("n"), F.min("low").alias("low"))
    out = kinds.groupBy("l_orderkey").agg(F.sum("n").alias("n_rows"), F.min("low").alias("score"), F.sort_array(F.collect_list("kind")).alias("kinds"))
    group = X.group_of(F.col("kinds"), F.array().cast("array<string>"), ["N"], ["A"])
    return out.select("l_orderkey", "n_rows", "score", F.array_join("kinds", ",").alias("kinds"), group.alias("group"))


@query(
    "reconcile",
    """with o as (select o_orderkey as k, o_custkey % 100 as w from orders), l as (select l_orderkey as k, count(*) as w from lineitem group by 1),
t as (select (select count(*) from o) + (select count(*) from l) - 2 * (select count(*) from o semi join l using (k)) as n, (select sum(w) from o) as total)
select 'both' as part, count(*) as n, cast(coalesce(sum(w), 0) as bigint) as weight from o semi join l using (k)
union all select 'missing', count(*), cast(coalesce(sum(w), 0) as bigint) from o anti join l using (k)
union all select 'untracked', count(*), cast(coalesce(sum(w), 0) as bigint) from l anti join o using (k)
union all select 'unbalanced', cast(t.n - (select count(*) from o anti join l using (k)) - (select count(*) from l anti join o using (k)) as bigint),
  cast(total - (select coalesce(sum(w), 0) from o semi join l using (k)) - (select coalesce(sum(w), 0) from o anti join l using (k)) as bigint) from t""",
)
def reconcile(spark, d):
    """Two inventories: in both, in one only, and a row whose number and weight are 0 when nothing is lost or counted twice.

    The totals that the parts are held against come from each inventory by itself.
    """
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 100).alias("size"))
    x = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    left = o.select("key", F.col("size").alias("own"), F.lit(True).alias("listed"))
    both = left.join(x.select("key", F.col("size").alias("found_size"), F.lit(True).alias("found")), "key", "full_outer")
    listed, found = F.col("listed").isNotNull(), F.col("found").isNotNull()
    parts = {"both": (listed & found, "own"), "missing": (listed & ~found, "own"), "untracked": (found & ~listed, "found_size")}
    counts = [c for name, (held, size) in parts.items() for c in (F.count_if(held).alias(f"n_{name}"), F.coalesce(F.sum(F.when(held, F.col(size))), F.lit(0)).alias(f"w_{name}"))]
    row = both.agg(*counts).join(o.agg(F.count(F.lit(1)).alias("n_o"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"))).join(x.agg(F.count(F.lit(1)).alias("n_x")))  # one row each
    seen = 2 * F.col("n_both") + F.col("n_missing") + F.col("n_untracked")
    rest = F.struct(F.lit("unbalanced").alias("part"), (F.col("n_o") + F.col("n_x") - seen).alias("n"), (F.col("total") - F.col("w_both") - F.col("w_missing")).alias("weight"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"n_{p}").alias("n"), F.col(f"w_{p}").alias("weight")) for p in parts], rest)))


@query(
    "missing_cause",
    """select c_custkey, case when c_acctbal < 0 then 'overdrawn' when not exists (select 1 from orders where o_custkey = c_custkey) then 'no orders'
  when not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then 'none filled' when c_mktsegment = 'BUILDING' then 'building' else 'placed' end as cause from customer""",
)
def missing_cause(spark, d):
    orders = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("filled"))
    rows = T(spark, d, "customer").join(orders, "c_custkey", "left")
    causes = {"overdrawn": F.col("c_acctbal") < 0, "no orders": F.col("filled").isNull(), "none filled": ~F.col("filled"), "building": F.col("c_mktsegment") == "BUILDING"}
    return records.first_cause(rows, causes, "placed").select("c_custkey", "cause")
