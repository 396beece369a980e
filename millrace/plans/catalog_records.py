"""Registered queries of the record operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import records as R
from millrace.plans import bindings as B
from millrace.plans.catalog import query

T = B.table


@query(
    "select_near_misses",
    f"""with {B.SNAPSHOTS} select key, unit, score from after_ where not exact and score >= 50 and size is not null and key - 1 not in (select key from after_)""",
)
def select_near_misses(spark, d):
    """Inexact keys of at least a score, with exclusions and without twins."""
    return R.near_misses(B.snapshot(spark, d, "after"), "key", F.col("key") - 1, 50).select("key", "unit", "score")


@query("last_wins", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def last_wins(spark, d):
    return R.last_wins(T(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "resolve_cascade",
    """with o as (select o_custkey as k, max(o_orderkey) as v from orders where o_orderstatus = 'F' group by 1), p as (select o_custkey as k, max(o_orderkey) as v from orders group by 1)
select c_custkey as k, coalesce(nullif(o.v, 0), nullif(p.v, 0)) as v, case when nullif(o.v, 0) is not null then 0 when nullif(p.v, 0) is not null then 1 end as source
from customer left join o on o.k = c_custkey left join p on p.k = c_custkey""",
)
def resolve_cascade(spark, d):
    orders = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    first = orders.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("v").alias("v"))
    second = orders.groupBy("k").agg(F.max("v").alias("v"))
    return R.first_present(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", [first, second], "v", F.lit(0))


@query(
    "slot_disagreement",
    """with x as (select o_custkey % 300 as tab, o_orderkey % 20 as slot, min(o_orderpriority) as v from orders where o_orderstatus = 'F' group by all), y as (select o_custkey % 300 as tab, o_orderkey % 20 as slot, min(o_orderpriority) as v from orders where o_orderstatus <> 'F' group by all),
j as (select tab, slot, x.v as ours, y.v as theirs from x join y using (tab, slot) where x.v <> y.v)
select tab, slot, ours, theirs, n as n_different from (select *, row_number() over (partition by tab order by slot) as rn, count(*) over (partition by tab) as n from j) where rn = 1""",
)
def slot_disagreement(spark, d):
    o = T(spark, d, "orders").select((F.col("o_custkey") % 300).alias("tab"), (F.col("o_orderkey") % 20).alias("slot"), F.col("o_orderpriority").alias("v"), "o_orderstatus")
    side = lambda df: df.groupBy("tab", "slot").agg(F.min("v").alias("v"))
    return R.first_disagreement(side(o.where("o_orderstatus = 'F'")), side(o.where("o_orderstatus <> 'F'")), "tab", "slot", "v")


@query(
    "ordinal_alignment",
    """with s as (select user_id, event_type, event_id % 2 as side, row_number() over (partition by user_id, event_id % 2 order by ts, event_id) as place, count(*) over (partition by user_id, event_id % 2) as size from events)
select x.user_id, x.place, x.event_type as ours, y.event_type as theirs from s x join s y on x.user_id = y.user_id and x.place = y.place and x.size = y.size where x.side = 0 and y.side = 1""",
)
def ordinal_alignment(spark, d):
    e = T(spark, d, "events")
    out = R.align_by_ordinal(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", F.col("place").cast("long").alias("place"), "ours", "theirs")


@query(
    "consistent_renaming",
    """with p as (select distinct l_orderkey as g, l_partkey % 5 as a, l_suppkey % 5 as b from lineitem), f as (select g, a, count(*) as n from p group by all), k as (select g, b, count(*) as n from p group by all)
select p.g, (select max(n) from f where f.g = p.g) = 1 and (select max(n) from k where k.g = p.g) = 1 as consistent, count(distinct a) as n_names, count(*) filter (where a <> b) as n_changed from p group by p.g""",
)
def consistent_renaming(spark, d):
    pairs = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"))
    return R.renaming(pairs, "g", "a", "b")


@query(
    "alias_swaps",
    """with c as (select o_custkey as a, (o_custkey // 2) * 4 + 1 - o_custkey as b, o_totalprice > 5000 as ok from orders),
p as (select a, min(b) as b from c group by a having min(b) = max(b) and bool_and(ok)) select x.a, x.b from p x join p y on y.a = x.b and y.b = x.a where x.a < x.b""",
)
def alias_swaps(spark, d):
    claims = T(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.expr("(o_custkey div 2) * 4 + 1 - o_custkey").alias("b"), "o_totalprice")
    return R.swaps(claims, "a", "b", F.col("o_totalprice") > 5000)


@query("merged_findings", "select o_orderstatus, o_orderpriority, month(o_orderdate) as m, string_agg(distinct cast(o_custkey % 7 as varchar), ',' order by cast(o_custkey % 7 as varchar)) as units, count(*) as n from orders group by 1, 2, 3")
def merged_findings(spark, d):
    rows = T(spark, d, "orders").withColumn("m", F.month("o_orderdate").cast("long")).withColumn("unit", F.col("o_custkey") % 7)
    return R.merge_by_key(rows, ["o_orderstatus", "o_orderpriority", "m"], "unit")


@query(
    "elsewhere_note",
    """with s as (select l_orderkey, list_sort(list(distinct l_returnflag || l_linestatus)) as names from lineitem group by 1)
select l_orderkey, case when len(names) <= 3 then len(names) || ': ' || array_to_string(names, ', ') else cast(len(names) as varchar) end as note from s""",
)
def elsewhere_note(spark, d):
    rows = T(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("name"))
    return R.note(rows, "l_orderkey", "name")


@query(
    "best_setting",
    """select l_suppkey % 31 as phase, count(*) filter (where l_returnflag = 'N') as n_exact, cast(sum(l_linenumber) as bigint) as cost from lineitem group by 1 order by 2 desc, 3, 1 limit 1""",
)
def best_setting(spark, d):
    rows = T(spark, d, "lineitem").withColumn("phase", F.col("l_suppkey") % 31)
    return R.best_setting(rows, "phase", F.col("l_returnflag") == "N", F.col("l_linenumber"))


@query(
    "search_steps",
    """with w as (select o_custkey, o_orderkey, o_totalprice, o_orderdate, o_orderstatus <> 'P' as ok, max(case when o_orderstatus <> 'P' then o_totalprice end) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as b from orders)
select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as step from w where ok and (b is null or o_totalprice > b)""",
)
def search_steps(spark, d):
    out = R.search_steps(T(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", F.col("o_orderstatus") != "P")
    return out.select("o_custkey", "o_orderkey", "o_totalprice", F.col("step").cast("long").alias("step"))


@query(
    "order_moves",
    """with s as (select user_id as item, epoch_us(ts) // 86400000000 as stage, min(event_id) as pos from events group by all), r as (select item, stage, pos, lag(pos) over w as before, lag(stage) over w as from_stage from s window w as (partition by item order by stage)),
k as (select item, stage, row_number() over (partition by stage order by before, item) as rank_before, row_number() over (partition by stage order by pos, item) as rank from r where from_stage = stage - 1)
select item, stage, rank_before, rank from k where rank <> rank_before""",
)
def order_moves(spark, d):
    stages = T(spark, d, "events").groupBy(F.col("user_id").alias("item"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("stage")).agg(F.min("event_id").alias("pos"))
    out = R.order_moves(stages, "item", "stage", "pos")
    return out.withColumns({c: F.col(c).cast("long") for c in ("rank_before", "rank")})


@query(
    "padding_groups",
    """with p as (select user_id, event_type in ('view', 'error') as pad, sum(case when event_type in ('view', 'error') then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as boundary from events)
select user_id, cast(boundary as bigint) as boundary, count(*) as n_padding from p where pad group by all""",
)
def padding_groups(spark, d):
    return R.padding_between(T(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("view", "error"))


@query(
    "pure_reorder",
    """with c as (select conv_id, string_split(text, ' ') as w, turn from conversations), p as (select x.conv_id, x.turn, x.w as a, y.w as b from c x join c y on x.conv_id = y.conv_id and y.turn = x.turn + 1)
select conv_id, turn, list_sort(a) = list_sort(b) as same_bag, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) as same_set from p""",
)
def pure_reorder(spark, d):
    """Is the next turn a mere reordering of this one's words?"""
    c = T(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    same = lambda f: f(F.col("a")) == f(F.col("b"))
    return p.select("conv_id", "turn", same(F.sort_array).alias("same_bag"), same(lambda x: F.sort_array(F.array_distinct(x))).alias("same_set"))


@query(
    "scalar_kernels",
    """select o_orderkey, case when o_orderkey * 7919 % 4294967296 >= 2147483648 then o_orderkey * 7919 % 4294967296 - 4294967296 else o_orderkey * 7919 % 4294967296 end as signed,
  nullif((o_custkey + o_orderkey) % 3 - 0, 0) as step, cast(o_orderkey as double) as address, replace(regexp_replace('src/' || o_orderpriority || '/a.cpp', '\\.cpp$', ''), '/', '__') as slug,
  case when 'T.' || (o_orderkey % 3) = 'T.0' and o_orderkey % 2 = 0 then cast(o_orderkey as varchar) when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) else 'T.' || (o_orderkey % 3) end as key from orders""",
)
def scalar_kernels(spark, d):
    o = T(spark, d, "orders")
    k = F.col("o_orderkey")
    ring = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), ((F.col("o_custkey") + k) % 3 + 1).cast("int"))
    symbol = F.concat(F.lit("T."), (k % 3).cast("string"))
    return o.select(
        "o_orderkey",
        X.signed(k * 7919 % 4294967296).alias("signed"),
        X.cyclic_step(F.lit("a"), ring, ["a", "b", "c"]).cast("long").alias("step"),
        X.address(F.concat(F.lit("0x"), F.lower(F.hex(k)))).cast("double").alias("address"),
        X.slug(F.concat(F.lit("src/"), "o_orderpriority", F.lit("/a.cpp"))).alias("slug"),
        X.function_key(symbol, F.when(k % 2 == 0, k.cast("string"))).alias("key"),
    )


@query(
    "top_lines",
    """select l_partkey, count(distinct l_orderkey) as n_functions, count(*) as n_findings from lineitem group by 1 order by 2 desc, 3 desc, 1 limit 20""",
)
def top_lines(spark, d):
    """A top-k report: the parts of most orders."""
    return R.busiest(T(spark, d, "lineitem"), "l_partkey", "l_orderkey", 20)


@query(
    "page_callees",
    r"""with m as (select page_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(html, '<!--.*$', ''), '<([a-z][a-z0-9]*)', 1), lambda x: x not in ('html', 'body', 'head'))) as tags from pages)
select page_id, array_to_string(list_sort(tags), ',') as tags, cast(len(tags) as int) as n_tags from m""",
)
def page_callees(spark, d):
    """Distinct names with exclusions, here of a page's elements, in order of name."""
    tags = F.array_distinct(F.filter(F.regexp_extract_all(F.regexp_replace("html", "<!--.*$", ""), F.lit("<([a-z][a-z0-9]*)"), 1), lambda x: ~x.isin("html", "body", "head")))
    return T(spark, d, "pages").select("page_id", F.array_join(F.array_sort(tags), ",").alias("tags"), F.size(tags).alias("n_tags"))
