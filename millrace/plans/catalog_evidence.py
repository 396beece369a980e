"""Registered queries of the evidence operators and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evidence as E
from millrace.operators import graphs, intervals
from millrace.plans import bindings as B
from millrace.plans.catalog import query

T = B.table


@query(
    "rejected_sites",
    """with f as (select o_custkey as name, cast(floor(o_totalprice) as bigint) as final_size, o_orderkey as initial_size from orders where o_orderstatus = 'P'),
once as (select name, min(final_size) as final_size, min(initial_size) as initial_size from f group by 1 having count(*) = 1),
g as (select l_suppkey as callee, min(l_linenumber) as growth from lineitem where l_quantity >= 49 group by 1 having count(distinct l_linenumber) = 1),
s as (select c_custkey as caller, c_custkey % 97 + 1 as callee from customer)
select s.caller, s.callee, a.final_size as caller_size, g.growth, a.final_size + g.growth as projected, case when a.name is not null and b.name is not null then greatest(a.initial_size, b.initial_size) end as base
from s left join once a on a.name = s.caller left join once b on b.name = s.callee left join g on g.callee = s.callee""",
)
def rejected_sites(spark, d):
    """Customers as call sites, with what is unique about the functions and edges they name."""
    functions = T(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("name"), F.floor("o_totalprice").cast("long").alias("final_size"), F.col("o_orderkey").alias("initial_size"))
    events = T(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("callee"), F.col("l_linenumber").alias("growth"))
    sites = T(spark, d, "customer").select(F.col("c_custkey").alias("caller"), (F.col("c_custkey") % 97 + 1).alias("callee"))
    return E.rejected_sites(sites, functions, events).select("caller", "callee", "caller_size", "growth", "projected", "base")


_FRONTIER = """s as (select user_id, event_type, event_id % 3 = 0 and event_id > 5000 as gone, row_number() over (partition by user_id order by ts, event_id) as place from events),
t as (select user_id, event_type, place, row_number() over (partition by user_id order by place) as "at" from s where not (place > 12 and gone)),
o as (select user_id, event_type, place as "at" from s where place <= 12),
j as (select coalesce(o.user_id, t.user_id) as user_id, coalesce(o."at", t."at") as "at", o.event_type as x, t.event_type as y from o full join t on t.user_id = o.user_id and t."at" = o."at"),
fr as (select user_id, count(x) as n_before, count(y) as n_after, count(*) filter (where x is null and y = 'error') as n_accepted, case when count(*) filter (where x is null and y = 'error') = 1 then min("at") filter (where x is null and y = 'error') end as "at"
  from j group by 1 having not bool_or(x is not null and x is distinct from y) and count(x) > 0)"""


def _streams(spark, d):
    """Users' first twelve events, and all of them but some that come later."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = T(spark, d, "events").withColumn("place", place)
    later = s.where("not (place > 12 and event_id % 3 = 0 and event_id > 5000)")
    return E.frontier(s.where("place <= 12"), later, "user_id", "place", ["event_type"], F.col("event_type") == "error")


@query("frontier", f"with {_FRONTIER} select * from fr")
def frontier(spark, d):
    return _streams(spark, d)


@query("frontier_join", f'''with {_FRONTIER}, w as (select c_custkey as user_id, min(c_nationkey) as site from customer group by 1 having count(*) = 1) select fr.user_id, "at", site from fr join w using (user_id) where n_accepted = 1''')
def frontier_join(spark, d):
    sites = T(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("site"))
    return E.frontier_join(_streams(spark, d), sites, "user_id")


@query(
    "disjoint_changes",
    """with c as (select o_custkey as k, case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then null else o_orderkey % 50 end as m from orders), r as (select c_custkey as k, c_nationkey as m from customer where c_acctbal > 0)
select c.k, case when bool_or(m is null) or not exists (select 1 from r where r.k = c.k) then null else not bool_or(exists (select 1 from r where r.k = c.k and r.m = c.m)) end as disjoint from c group by c.k""",
)
def disjoint_changes(spark, d):
    """Do none of a customer's changed members lie in its reached set? Doubt is null."""
    gone = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), F.lit(None)).otherwise(F.col("o_orderkey") % 50)
    changed = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), gone.alias("m"))
    reached = T(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("m"))
    return E.disjoint(changed, reached, "k", "m")


@query(
    "dependents",
    """with u as (select o_custkey as unit, string_agg('h' || o_orderkey % 40, ' ') as listing from orders group by 1), w as (select distinct unit, unnest(string_split(listing, ' ')) as path from u)
select path, unit from w where path in (select 'h' || s_nationkey from supplier)""",
)
def dependents(spark, d):
    """Units whose dependency listing names a supplier's nation."""
    word = F.concat(F.lit("h"), (F.col("o_orderkey") % 40).cast("string"))
    units = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.array_join(F.collect_list(word), " \n").alias("listing"))
    return E.dependents(units, "unit", "listing", T(spark, d, "supplier").select(F.concat(F.lit("h"), F.col("s_nationkey").cast("string")).alias("path")), "path")


@query(
    "calls_inside",
    """with s as (select l_orderkey, l_linenumber, l_suppkey as body, l_partkey % 20 as name, case when l_linenumber % 2 = 0 then l_partkey % 50 end as address from lineitem), b as (select s_suppkey as body, s_nationkey % 20 as name, s_suppkey * 3 % 50 as address from supplier)
select s.l_orderkey, count(*) as n, count(*) filter (where exists (select 1 from b where b.body = s.body and (b.name = s.name or b.address = s.address))) as n_inside from s group by 1""",
)
def calls_inside(spark, d):
    p = F.col("l_partkey")
    sites = T(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("body"), (p % 20).alias("name"), F.when(F.col("l_linenumber") % 2 == 0, p % 50).alias("address"))
    bodies = T(spark, d, "supplier").select(F.col("s_suppkey").alias("body"), (F.col("s_nationkey") % 20).cast("long").alias("name"), (F.col("s_suppkey") * 3 % 50).alias("address"))
    return E.calls_inside(sites, bodies, "name", "address").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"))


@query(
    "aligned_references",
    """with s as (select o_custkey, o_orderstatus, month(o_orderdate) as m, o_orderpriority as v, o_orderkey, row_number() over w as ordinal, count(*) over (partition by o_custkey, month(o_orderdate), o_orderstatus) as n from orders where o_orderstatus in ('F', 'O') window w as (partition by o_custkey, month(o_orderdate), o_orderstatus order by o_orderkey))
select a.o_custkey, a.m, cast(a.ordinal as int) as ordinal, a.v as ours, b.v as theirs from s a join s b on a.o_custkey = b.o_custkey and a.m = b.m and a.ordinal = b.ordinal and a.n = b.n where a.o_orderstatus = 'F' and b.o_orderstatus = 'O'""",
)
def aligned_references(spark, d):
    o = T(spark, d, "orders").withColumn("m", F.month("o_orderdate").cast("long"))
    return E.aligned_references(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey", "m"], "o_orderkey", "o_orderpriority")


@query(
    "grant_before",
    """with w as (select *, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as b from events),
f as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from w where value > 100) select user_id, event_id as "at", case when event_type = 'click' then b end as before from f where rn = 1""",
)
def grant_before(spark, d):
    return E.grant_before(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 100, F.col("event_type") == "click", "event_id")


@query(
    "changed_rows",
    """with s as (select o_custkey, o_orderstatus, o_orderpriority as v, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as place, count(*) over (partition by o_custkey, o_orderstatus) as n from orders)
select a.o_custkey, count(*) as n, count(*) filter (where a.v <> b.v) as n_changed, min(case when a.v <> b.v then a.place end) as first from s a join s b on a.o_custkey = b.o_custkey and a.place = b.place and a.n = b.n where a.o_orderstatus = 'F' and b.o_orderstatus = 'O' group by 1""",
)
def changed_rows(spark, d):
    o = T(spark, d, "orders")
    return E.changed_rows(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority")


@query(
    "missing_guards",
    """with s as (select *, event_id % 2 as side from events), l as (select *, lead(event_type) over w as e2, lead(event_id % 3) over w as m2, event_id % 3 as m1 from s window w as (partition by user_id, side order by ts, event_id)),
p as (select *, row_number() over (partition by user_id, side, event_type, e2, m1, m2 order by ts, event_id) as nth from l where event_type = 'view' and e2 in ('click', 'error')),
c as (select user_id, event_type, e2, m1, m2, count(*) as n from p where side = 1 group by all)
select p.user_id, p.event_id from p left join c on c.user_id = p.user_id and c.event_type = p.event_type and c.e2 = p.e2 and c.m1 = p.m1 and c.m2 = p.m2 where p.side = 0 and nth > coalesce(c.n, 0)""",
)
def missing_guards(spark, d):
    """A view that a click or an error follows, beyond as many of the other side."""
    e = T(spark, d, "events").withColumn("m", F.col("event_id") % 3)
    kind = F.col("event_type")
    return E.missing_guards(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", ["ts", "event_id"], kind == "view", kind.isin("click", "error"), ["event_type", "m"], "event_id")


@query(
    "block_context",
    """select l_orderkey, coalesce(string_agg(distinct case when l_returnflag <> 'R' and l_partkey % 3 <> 0 then 'v' || l_partkey % 7 end, ',' order by case when l_returnflag <> 'R' and l_partkey % 3 <> 0 then 'v' || l_partkey % 7 end), '') as definitions,
  coalesce(string_agg(case when l_returnflag = 'R' then cast(l_suppkey as varchar) end, ',' order by l_partkey, cast(l_suppkey as varchar)), '') as successors, count(*) filter (where l_returnflag <> 'R' and l_partkey % 3 = 0) as n_other from lineitem group by 1""",
)
def block_context(spark, d):
    name = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("v"), (F.col("l_partkey") % 7).cast("string")))
    return E.block_context(T(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", F.col("l_returnflag") == "R", "l_suppkey", name)


@query(
    "attributed_lines",
    """with o as (select distinct p_partkey as k from part where p_size < 25), f as (select l_partkey as k, l_linenumber as depth, l_suppkey % 500 as line, row_number() over (partition by l_partkey order by l_linenumber, l_suppkey % 500) as rn from lineitem where l_returnflag <> 'A')
select distinct line from f join o using (k) where rn = 1""",
)
def attributed_lines(spark, d):
    offsets = T(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    frames = T(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("depth"), (F.col("l_suppkey") % 500).alias("line"), "l_returnflag")
    return E.attributed(offsets, frames, "k", "line", F.col("l_returnflag") != "A")


@query(
    "compared_bags",
    """with b as (select o_custkey, unnest(['callee', 'constant', 'indirect']) as kind, unnest([o_orderpriority, cast(o_orderkey % 5 as varchar), '*']) as v, o_orderstatus = 'F' as ours from orders where o_orderstatus in ('F', 'O')),
c as (select o_custkey, kind, v, count(*) filter (where ours) as o, count(*) filter (where not ours) as t from b group by all)
select o_custkey, kind, cast(sum(greatest(o - t, 0)) as bigint) as ours_only, cast(sum(greatest(t - o, 0)) as bigint) as theirs_only from c group by 1, 2 having sum(abs(o - t)) > 0""",
)
def compared_bags(spark, d):
    """Callees, constants and numbers of indirect calls of each customer, filled against open orders."""
    item = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("v"))
    rows = T(spark, d, "orders").select("o_custkey", "o_orderstatus", F.inline(F.array(item("callee", F.col("o_orderpriority")), item("constant", F.col("o_orderkey") % 5), item("indirect", F.lit("*")))))
    return E.compare_bags(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), ["o_custkey"], "kind", "v")


@query(
    "copy_verdicts",
    """with c as (select l_suppkey % 50 as unit, l_partkey % 300 as symbol, cast(l_quantity as bigint) as size from lineitem), r as (select s_nationkey as unit, s_suppkey % 300 as symbol from supplier where s_acctbal > 4000), h as (select distinct p_partkey % 50 as unit, cast(p_size as bigint) as size from part where p_partkey % 3 = 0)
select unit, case when exists (select 1 from r where r.symbol = c.symbol and r.unit = c.unit) then 'expected' when exists (select 1 from r where r.symbol = c.symbol) then 'elsewhere' when exists (select 1 from h where h.unit = c.unit and h.size = c.size) then 'possible-home' else 'surplus' end as verdict, count(*) as n from c group by all""",
)
def copy_verdicts(spark, d):
    """Line items as copies without a place, by verdict and unit."""
    copies = T(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("unit"), (F.col("l_partkey") % 300).alias("symbol"), F.col("l_quantity").cast("long").alias("size"))
    credited = T(spark, d, "supplier").where("s_acctbal > 4000").select(F.col("s_nationkey").cast("long").alias("unit"), (F.col("s_suppkey") % 300).alias("symbol"))
    homes = T(spark, d, "part").where("p_partkey % 3 = 0").select((F.col("p_partkey") % 50).alias("unit"), F.col("p_size").cast("long").alias("size"))
    return E.copy_verdicts(copies, credited, homes).groupBy("unit", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "copy_context",
    """with p as (select o_orderkey, o_orderkey % 1000 as x from orders), r as (select s_suppkey as symbol, s_suppkey * 7 % 900 as lo, s_suppkey * 7 % 900 + 20 as hi from supplier),
w as (select o_orderkey, symbol from p join r on x between lo and hi), c as (select s_suppkey as symbol, s_acctbal > 0 as exact from supplier where s_nationkey < 20)
select o_orderkey, case when bool_or(exact) then 'caller-context' when count(exact) > 0 then 'header-candidate' else 'header-unverified' end as context, count(exact) as n_copies from w left join c using (symbol) group by 1""",
)
def copy_context(spark, d):
    """Orders as findings at lines, suppliers as definitions over ranges of lines and as their copies."""
    points = T(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("x"))
    s = F.col("s_suppkey")
    ranges = T(spark, d, "supplier").select(s.alias("symbol"), (s * 7 % 900).alias("lo"), (s * 7 % 900 + 20).alias("hi"))
    copies = T(spark, d, "supplier").where("s_nationkey < 20").select(s.alias("symbol"), (F.col("s_acctbal") > 0).alias("exact"))
    return E.copy_context(points, "x", ["o_orderkey"], ranges, "lo", "hi", copies, "symbol")


@query(
    "described",
    """with f as (select user_id, event_id as "at", event_type as cause from events where event_id % 2 = 1), r as (select user_id, event_id as "at", event_id * 10 as line from events where event_id % 2 = 0 and event_type <> 'error'),
l as (select f.*, (select r.line from r where r.user_id = f.user_id and r."at" <= f."at" order by r."at" desc limit 1) as line from f)
select user_id, arg_min(cause, "at") as cause, arg_min(coalesce(line, -1), "at") as first_line, count(distinct line) as n_lines from l group by 1""",
)
def described(spark, d):
    """Users' odd events as findings: the first one's cause, and the lines of even ones at or before them."""
    e = T(spark, d, "events")
    findings = e.where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("cause"))
    records = e.where("event_id % 2 = 0 and event_type <> 'error'").select("user_id", F.col("event_id").alias("at"), (F.col("event_id") * 10).alias("line"))
    return E.described(findings, records, "user_id").withColumn("first_line", F.coalesce("first_line", F.lit(-1)))


@query("previous_rows", "select o_orderkey, lag(o_orderkey) over w as previous_key, lag(o_orderstatus) over w as previous_status from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def previous_rows(spark, d):
    rows = E.with_previous(T(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return rows.select("o_orderkey", F.col("previous.o_orderkey").alias("previous_key"), F.col("previous.o_orderstatus").alias("previous_status"))


@query(
    "layout_gate",
    """with b as (select l_suppkey as unit, l_partkey as item, bool_and(l_returnflag <> 'A') as same, min(l_quantity) < 40 as placed from lineitem where l_linestatus = 'F' group by all), a as (select l_suppkey as unit, l_partkey as item, bool_and(l_returnflag <> 'R') as same, min(l_quantity) < 45 as placed from lineitem where l_linestatus = 'F' or (l_suppkey % 2 = 0 and l_partkey % 5 = 0) group by all),
j as (select coalesce(b.unit, a.unit) as unit, b.unit is null or a.unit is null as ch, b.same and not a.same as rg, b.placed and not a.placed as ls, not b.same and a.same as im from b full join a on a.unit = b.unit and a.item = b.item),
g as (select unit, bool_or(ch) as ch, coalesce(bool_or(rg), false) as rg, coalesce(bool_or(ls), false) as ls, count(*) filter (where im) as n_improved from j group by 1)
select unit, not ch and not rg and not ls and n_improved > 0 as improves, case when ch then 'object set changed' when rg then 'regressed' when ls then 'placement became ambiguous' when n_improved > 0 then 'improved' else 'no improvement' end as reason, n_improved from g""",
)
def layout_gate(spark, d):
    x = T(spark, d, "lineitem")
    side = lambda df, flag, most: df.groupBy(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("item")).agg(F.bool_and(F.col("l_returnflag") != flag).alias("same"), (F.min("l_quantity") < most).alias("placed"))
    return E.layout_gate(side(x.where("l_linestatus = 'F'"), "A", 40), side(x.where("l_linestatus = 'F' or (l_suppkey % 2 = 0 and l_partkey % 5 = 0)"), "R", 45), "unit", "item")


@query(
    "improvement_gate",
    f"""with {B.SNAPSHOTS}, u as (select b.unit, not bool_or(coalesce(a.score, 0) < b.score and b.key % 7 <> 0) as preserves from before_ b left join after_ a using (key) group by b.unit)
select coalesce(b.key, a.key) as key, coalesce(coalesce(u.preserves, true) and case when b.key is null then coalesce(a.key, 0) % 3 = 0 and a.exact else a.score > b.score or (a.exact and not b.exact) end, false) as keep
from before_ b full join after_ a on a.key = b.key left join u on u.unit = coalesce(b.unit, a.unit)""",
)
def improvement_gate(spark, d):
    """Keys whose candidate is kept: better, or new, known and exact, in units that lose nothing else."""
    b, a = (B.snapshot(spark, d, s).select("key", "unit", F.col("exact").alias(f"{s}_exact"), F.col("score").alias(f"{s}_score")) for s in ("before", "after"))
    lost = (F.coalesce("after_score", F.lit(0.0)) < F.col("before_score")) & (F.col("key") % 7 != 0)
    units = b.join(a.drop("unit"), "key", "left").groupBy("unit").agg((~F.bool_or(lost)).alias("preserves"))
    both = b.join(a.withColumnRenamed("unit", "unit_after"), "key", "full_outer").withColumn("unit", F.coalesce("unit", "unit_after"))
    rows = both.join(units, "unit", "left")
    keep = E.keep_improvement(F.coalesce("preserves", F.lit(True)), F.col("before_exact"), F.col("after_exact"), F.col("before_score"), F.col("after_score"), F.col("key") % 3 == 0)
    return rows.select("key", keep.alias("keep"))


@query("behaviour_gate", "select o_orderkey, case when o_orderstatus = 'P' or o_orderkey % 2 = 0 then true else o_custkey % 10 < o_orderkey % 10 end as keep from orders")
def behaviour_gate(spark, d):
    """Behaviour unknown for pending orders, the same for even ones; the others count their differences."""
    same = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderkey") % 2 == 0)
    return T(spark, d, "orders").select("o_orderkey", E.behaviour_gate(same, F.col("o_orderkey") % 10, F.col("o_custkey") % 10).alias("keep"))


@query(
    "exact_unless_failed",
    """select l_suppkey, case when not bool_or(l_quantity = 50) then coalesce(string_agg(distinct case when l_returnflag = 'N' then cast(l_linenumber as varchar) end, ',' order by case when l_returnflag = 'N' then cast(l_linenumber as varchar) end), '') end as symbols,
  case when not bool_or(l_quantity = 50) then cast(count(distinct case when l_returnflag = 'N' then l_linenumber end) as int) end as n from lineitem group by 1""",
)
def exact_unless_failed(spark, d):
    return E.exact_unless_failed(T(spark, d, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_returnflag") == "N", F.col("l_quantity") == 50)


@query(
    "same_code",
    """with x as (select o_custkey as unit, month(o_orderdate) % 2 as section, o_orderstatus as s, o_orderpriority as c, o_orderkey % 3 as k from orders), c as (select unit, section, c, k, count(*) filter (where s = 'F') as b, count(*) filter (where s = 'O') as a from x where s in ('F', 'O') group by all)
select unit, bool_and(a = b) as same from c group by 1""",
)
def same_code(spark, d):
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("unit"), (F.month("o_orderdate") % 2).alias("section"), "o_orderstatus", F.col("o_orderpriority").alias("content"), (F.col("o_orderkey") % 3).alias("k"))
    return E.same_code(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "unit", "section", "content", ["k"])


@query(
    "unique_edits",
    """with e as (select n_nationkey as n, n_name as old from nation), s as (select conv_id * 1000 + turn as key, text from conversations)
select key, w as name, sha256(replace(text, w, '<' || w || '>')) as digest from s, (select unnest(['the ', 'and ', 'is ']) as w) where length(text) - length(replace(text, w, '')) = length(w)""",
)
def unique_edits(spark, d):
    """Turns in which a word stands exactly once, with it marked."""
    words = F.explode(F.array(*map(F.lit, ["the ", "and ", "is "])))
    turns = T(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    edits = turns.select("key", words.alias("name")).withColumns({"old": F.col("name"), "new": F.concat(F.lit("<"), "name", F.lit(">"))})
    return E.unique_edits(turns, edits, "key", "text").select("key", "name", F.sha2("result", 256).alias("digest"))


@query("unambiguous_members", "select l_orderkey as name, min(l_returnflag) as member from lineitem group by 1 having count(distinct l_returnflag) = 1")
def unambiguous_members(spark, d):
    rows = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("member"))
    return E.unique_value(rows, ["name"], "member")


@query(
    "header_users",
    """with recursive m as (select count(*) as m from supplier), e as (select s_suppkey as s, (7 * s_suppkey + 3) % m as t from supplier, m), r(root, node) as (select s_suppkey, s_suppkey from supplier where s_suppkey <= 20 union select r.root, e.t from r join e on e.s = r.node)
select root from r group by root having bool_or(node = 3 or node = 24)""",
)
def header_users(spark, d):
    """Of several roots those whose closure holds one of two nodes."""
    s = T(spark, d, "supplier").select("s_suppkey")
    m = s.agg(F.count(F.lit(1)).alias("m"))
    edges = s.join(F.broadcast(m)).select(F.col("s_suppkey").alias("source"), ((7 * F.col("s_suppkey") + 3) % F.col("m")).alias("target"))  # m is one row
    roots = s.where("s_suppkey <= 20").select(F.col("s_suppkey").alias("root"))
    wanted = s.where("s_suppkey in (3, 24)").select(F.col("s_suppkey").alias("node"))
    return graphs.users(edges, roots, wanted)


@query(
    "memory_frontier",
    """with recursive w as (select s_suppkey * 4 as address, case when s_suppkey % 5 = 0 then 0 else (s_suppkey * 7 % 2000) * 4 end as next, s_nationkey as priority, s_suppkey % 11 <> 0 as valid from supplier),
r("at") as (select 4 * k from (select unnest([1, 2, 3, 5]) as k) union select w.next from r join w on w.address = r."at" where w.valid and w.next <> 0)
select r."at", case when w.address is null then 'unread' when not valid then 'stale' else 'live' end as state, w.priority from r left join w on w.address = r."at" """,
)
def memory_frontier(spark, d):
    """Records chained in memory from four heads: live ones with their priority, stale ones, and addresses still to read."""
    s = F.col("s_suppkey")
    records = T(spark, d, "supplier").select((s * 4).alias("address"), F.when(s % 5 == 0, 0).otherwise(s * 7 % 2000 * 4).alias("next"), F.col("s_nationkey").alias("priority"), (s % 11 != 0).alias("valid"))
    heads = T(spark, d, "supplier").where("s_suppkey in (1, 2, 3, 5)").select((s * 4).alias("at"))
    return graphs.chained(records, heads, "address", "next", "valid").select("at", "state", "priority")


@query("learned_claims", "select l_orderkey as node, min(l_suppkey) as value from lineitem group by 1 having count(distinct l_suppkey) = 1")
def learned_claims(spark, d):
    """Claims that don't contradict each other; ``graphs.learn`` fails on ones that do."""
    claims = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("value"))
    return graphs.learned(E.unique_value(claims, ["node"], "value"), claims.limit(0))


@query(
    "contracts",
    """with n as (select p_partkey, (['_ZNSt', '_ZNKSt', '_ZN3'])[p_partkey % 3 + 1] || '7__cxx11' || (['4listI', '6vectorI'])[p_size % 2 + 1] || 'iE' || (['8_M_eraseESt14_List_iteratorIiE', '5eraseE'])[p_partkey % 2 + 1] as name from part)
select p_partkey, case when p_partkey % 3 = 0 and name like '%4listI%' and name like '%8_M_eraseESt14_List_iterator%' then 'std::list::_M_erase(iterator) returns void' end as contract, case when name like '%vector%' then 'src/' || p_partkey || '.h' else 'src/last.h' end as editable from n""",
)
def contracts(spark, d):
    """What a library name promises, and the first of a chain's frames in our own sources."""
    k = F.col("p_partkey")
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    name = F.concat(pick(["_ZNSt", "_ZNKSt", "_ZN3"], k), F.lit("7__cxx11"), pick(["4listI", "6vectorI"], F.col("p_size")), F.lit("iE"), pick(["8_M_eraseESt14_List_iteratorIiE", "5eraseE"], k))
    folder = F.when(name.contains("vector"), "src/").otherwise("/usr/include/")
    frames = F.array(F.struct(F.lit("/usr/include/a.h").alias("path")), F.struct(F.concat(folder, k.cast("string"), F.lit(".h")).alias("path")), F.struct(F.lit("src/last.h").alias("path")))
    return T(spark, d, "part").select("p_partkey", X.void_contract(name).alias("contract"), X.first_under(frames, "src/")["path"].alias("editable"))


@query(
    "completed_listing",
    """select conv_id, turn, case when length(text) > 40 then text else 'short' end as line from conversations""",
)
def completed_listing(spark, d):
    """Turns cut at 40 characters, completed from the source by their number."""
    number = (F.col("conv_id") * 1000 + F.col("turn")).alias("number")
    source = T(spark, d, "conversations").select(number, "conv_id", "turn", F.when(F.length("text") > 40, F.col("text")).otherwise("short").alias("line"))
    listing = source.withColumn("line", F.substring("line", 1, 40)).withColumn("cut", F.length("line") == 40)
    return E.completed(listing, source, "number", "line", F.col("cut")).select("conv_id", "turn", "line")


@query(
    "reference_targets",
    """with r as (select l_orderkey as k, l_linenumber as n, l_suppkey % 5 as section, l_partkey % 50 + case when l_linenumber % 2 = 0 then 4 else 0 end as place from lineitem), f as (select s_suppkey % 5 as section, s_suppkey % 40 as start, min(s_name) as name from supplier group by 1, 2)
select r.k, r.section, coalesce(f.name, cast(r.section as varchar)) as name, cast(case when f.name is not null then 0 else place end as bigint) as "offset", count(*) as n from r left join f on f.section = r.section and f.start = r.place group by all""",
)
def reference_targets(spark, d):
    """Line items as references into five sections: a function's name where one starts, else section and offset."""
    s = F.col("s_suppkey")
    functions = T(spark, d, "supplier").groupBy((s % 5).alias("section"), (s % 40).alias("start")).agg(F.min("s_name").alias("name"))
    rows = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).alias("section"), (F.col("l_partkey") % 50).alias("addend"), (F.col("l_linenumber") % 2 == 0).alias("relative"))
    found = E.references(rows, functions, "section", X.reference_place(F.lit(0).cast("long"), F.col("addend"), F.col("relative"), F.lit(0)))
    return found.groupBy("k", "section", "name", F.col("offset").cast("long").alias("offset")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_constructs",
    """with l as (select conv_id as path, turn as line, trim(text) as construct from conversations), w as (select c_custkey as k, c_custkey % 200 as path, c_custkey % 9 as line from customer) select w.k, w.path, w.line, sha256(construct) as digest from w left join l on l.path = w.path and l.line = w.line""",
)
def source_constructs(spark, d):
    """Customers as locations in conversations: the text that stands there."""
    k = F.col("c_custkey")
    places = T(spark, d, "customer").select(k.alias("k"), (k % 200).alias("path"), (k % 9).alias("line"))
    lines = T(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), "text")
    return E.constructs(places, lines).select("k", "path", "line", F.sha2("construct", 256).alias("digest"))


@query("evidence_kinds", "select split_part(url, ':', 1) as kind, count(*) as n from pages where split_part(url, ':', 1) in ('http', 'https') group by 1")
def evidence_kinds(spark, d):
    return E.of_kinds(T(spark, d, "pages"), "url", ["http", "https"]).groupBy(F.split_part("url", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "own_exact_functions",
    """select distinct l_suppkey, 'F' || l_partkey as name from lineitem where l_returnflag = 'N' and not ('F' || l_partkey like 'F1%') and exists (select 1 from part where p_partkey = l_partkey and p_size % 10 = l_suppkey % 10)""",
)
def own_exact_functions(spark, d):
    """Exact functions that their own unit defines, without some prefixes."""
    rows = T(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("name"), "l_returnflag", "l_partkey")
    defined = rows.join(T(spark, d, "part"), (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") % 10 == F.col("l_suppkey") % 10))
    return E.own_exact(rows, defined, ["l_suppkey", "name"], F.col("l_returnflag") == "N", ["F1"])


@query("other_scores", f"with {B.SNAPSHOTS} select unit, key, score from after_ where key <> unit * 4")
def other_scores(spark, d):
    """All scores of a unit but those of one key."""
    return B.snapshot(spark, d, "after").where(F.col("key") != F.col("unit") * 4).select("unit", "key", "score")


@query("new_claims", "select distinct l_partkey from lineitem where l_shipdate >= timestamp '1998-01-01' and l_partkey not in (select l_partkey from lineitem where l_shipdate < timestamp '1995-03-01')")
def new_claims(spark, d):
    """Parts that only the later lines name."""
    x = T(spark, d, "lineitem")
    day = lambda t: F.lit(t).cast("timestamp_ntz")
    later, before = x.where(F.col("l_shipdate") >= day("1998-01-01")), x.where(F.col("l_shipdate") < day("1995-03-01"))
    return later.select("l_partkey").distinct().join(before.select("l_partkey"), "l_partkey", "left_anti")


@query(
    "gathered",
    """with f as (select o_custkey as unit, o_orderkey as symbol, cast(floor(o_totalprice) as bigint) as size, o_orderstatus = 'P' as bad from orders), n as (select l_orderkey as symbol, count(*) as n from lineitem where l_returnflag = 'R' group by 1)
select unit, symbol, size, n, null as reason from f join n using (symbol) where not bad union all select unit, symbol, null, null, 'unreadable' from f where bad""",
)
def gathered(spark, d):
    """Orders with returned lines by size, and those that were skipped with the reason."""
    functions = T(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("symbol"), F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderstatus") == "P").alias("bad"))
    lines = T(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("symbol"))
    differences = lines.join(functions.select("unit", "symbol"), "symbol")
    found, skipped = E.gathered(functions, differences, ["unit", "symbol"], "size", F.col("bad"))
    none = F.lit(None)
    return found.select("unit", "symbol", "size", "n", none.cast("string").alias("reason")).union(skipped.select("unit", "symbol", none.cast("long"), none.cast("long"), "reason"))


@query(
    "identity_keys",
    """with k as (select case when l_linenumber = 1 then 'text ' || l_returnflag else 'at ' || l_suppkey % 10 || ' ' || l_partkey % 10 end as reference, l_quantity % 5 || '|' || coalesce(case when l_linestatus = 'O' then 'cmp' end, '-') || '|' || l_returnflag as constant from (select l_linenumber, l_returnflag, l_suppkey, l_partkey, cast(l_quantity as bigint) as l_quantity, l_linestatus from lineitem))
select reference, constant, count(*) as n from k group by 1, 2""",
)
def identity_keys(spark, d):
    """Line items as references and constants, counted by what tells them apart."""
    c = F.col
    reference = X.reference_key(F.when(c("l_linenumber") == 1, c("l_returnflag")), c("l_suppkey") % 10, c("l_partkey") % 10)
    constant = X.constant_key(c("l_quantity").cast("long") % 5, F.when(c("l_linestatus") == "O", "cmp"), c("l_returnflag"))
    return T(spark, d, "lineitem").groupBy(reference.alias("reference"), constant.alias("constant")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "edit_families",
    """with e as (select o_custkey as unit, o_orderpriority as symbol, o_orderkey as k, o_orderstatus || o_orderkey % 10 as name from orders) select unit, symbol, count(*) as n, string_agg(name, ',' order by k) as names from e group by 1, 2""",
)
def edit_families(spark, d):
    """Orders as registered edits of their customer's symbols, the two halves of the year taken together."""
    o = T(spark, d, "orders")
    name = F.concat("o_orderstatus", (F.col("o_orderkey") % 10).cast("string"))
    half = lambda rows: rows.select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("k"), name.alias("name"))
    first = F.month("o_orderdate") <= 6
    return E.families(E.together([half(o.where(first)), half(o.where(~first))]), ["unit", "symbol"], "name", "k")
