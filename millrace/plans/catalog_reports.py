"""Registered queries of traces, censuses of frames and flips, and reports as pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import render
from millrace.operators import findings as D
from millrace.operators import reports as R
from millrace.operators import traces as V
from millrace.plans import bindings as B
from millrace.plans.catalog import query
from millrace.sources import dumps, scratch, tables

T = B.table


def _pick(values, c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


# --- traces --------------------------------------------------------------------------------------


def _trace(spark, d):
    """Users' events as register searches on a ring of four; some users' files, objects and histories are bad."""
    e = T(spark, d, "events")
    u, k = F.col("user_id"), F.col("event_id")
    w = Window.partitionBy("unit").orderBy("ts", "event_id")
    rows = e.select(u.alias("unit"), "ts", "event_id", (F.col("event_type") != "error").alias("success"))
    rows = rows.withColumn("number", F.row_number().over(w) - 1).withColumn("after", F.when(F.col("success"), k % 4).otherwise(0).cast("int"))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)) + F.when(k % 397 == 0, 1).otherwise(0))
    turn = (F.col("unit") % 4).cast("int")
    order = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(i + turn, F.lit(4)))
    order = F.when(k % 389 == 0, F.array(*[F.lit(0)] * 4)).otherwise(order)
    register = F.when(F.col("success") | (k % 383 == 0), F.pmod(F.col("after") - 1 + turn + F.when(k % 379 == 0, 1).otherwise(0), F.lit(4)))
    events = rows.select("unit", "number", "before", "after", order.alias("order"), register.cast("int").alias("register"), "success", F.when(k % 373 == 0, "").otherwise("f").alias("function"), F.lit(1).alias("uid"))
    units = e.select(u.alias("unit")).distinct()
    n = F.col("unit")
    collections = units.select("unit", (n % 17 != 0).alias("verified"), F.when(n % 13 == 0, 1).otherwise(0).alias("exit_code"), F.when(n % 29 == 0, 2).otherwise(0).alias("n_errors"), F.lit(4).alias("n_registers"))
    content = F.concat(F.lit("c"), n.cast("string"))
    files = units.where("unit % 23 <> 0").select("unit", F.lit("events.json").alias("path"), content.alias("content"))
    artifacts = units.select("unit", F.lit("events.json").alias("path"), F.when(n % 19 == 0, "other").otherwise(F.sha2(content.cast("binary"), 256)).alias("sha256"))
    return collections, artifacts, files, events


@query(
    "trace_faults",
    """with r as (select user_id as unit, event_id as k, event_type <> 'error' as success, row_number() over w - 1 as number, case when event_type <> 'error' then event_id % 4 else 0 end as after, lag(case when event_type <> 'error' then event_id % 4 else 0 end) over w as prior from events window w as (partition by user_id order by ts, event_id)),
h as (select unit, number, case when k % 397 = 0 then 'discontinuous' when k % 389 = 0 then 'invalid order' when k % 373 = 0 then 'invalid event' when success and (k % 379 = 0) then 'does not advance' when not success and k % 383 = 0 then 'does not reset' end as fault from r),
f as (select unit, arg_min(fault, number) as history from h where fault is not null group by 1), u as (select distinct user_id as unit from events)
select unit, coalesce(case when unit % 23 = 0 then 'artifact missing' when unit % 19 = 0 then 'artifact changed' when unit % 17 = 0 then 'object not verified' when unit % 13 = 0 or unit % 29 = 0 then 'incomplete trace' end, history) as fault from u left join f using (unit)
where unit % 23 = 0 or unit % 19 = 0 or unit % 17 = 0 or unit % 13 = 0 or unit % 29 = 0 or history is not null""",
)
def trace_faults(spark, d):
    """Why a user's trace can't be used."""
    return V.trace_faults(*_trace(spark, d))


@query(
    "dump_faults",
    """with u as (select s_suppkey as unit from supplier), x as (select l_suppkey as unit, bool_or(l_partkey % 211 = 0) as other from (select distinct l_suppkey, l_partkey from lineitem) group by 1)
select unit, case when other then 'function differs' when unit % 5 = 0 then 'dump changed' else 'warnings changed' end as fault from u left join x using (unit) where coalesce(other, false) or unit % 5 = 0 or unit % 7 = 1""",
)
def dump_faults(spark, d):
    """Suppliers as units whose dump is held against a canonical build: parts as functions, some with other relocations, some files edited."""
    units = T(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    n = F.col("unit")
    collections = units.select("unit", F.lit("a.inline").alias("dump"), F.when(n % 3 != 2, "err.txt").when(n % 7 == 1, "gone.txt").alias("warnings"))
    path = F.explode(F.array(F.lit("a.inline"), F.lit("err.txt"))).alias("path")
    files = units.select("unit", path).withColumn("content", F.concat("path", n.cast("string")))
    bad = ((F.col("path") == "a.inline") & (n % 5 == 0)) | ((F.col("path") == "err.txt") & (n % 7 == 1))
    artifacts = files.select("unit", "path", F.when(bad, "x").otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"))
    functions = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("symbol")).distinct().select("unit", "symbol", (F.col("symbol") * 3).alias("code"), F.array("symbol").alias("relocations"))
    canonical = functions.withColumn("relocations", F.when(F.col("symbol") % 211 == 0, F.array()).otherwise(F.col("relocations")))
    return V.dump_faults(collections, functions, canonical, artifacts, files)


# --- censuses ------------------------------------------------------------------------------------


_FRAMES = """c as (select l_suppkey % 10 as unit, 's' || l_partkey as symbol, l_partkey as address, case when l_partkey % 11 = 0 then -1 else l_partkey end as known, p_size as size, case when l_partkey % 7 = 0 then p_size + 1 else p_size end as target_size, l_partkey % 5 as calls, case when l_partkey % 13 = 0 then 9 else l_partkey % 5 end as target_calls, cast(l_quantity as bigint) * 2 as score, l_returnflag = 'A' as exact, (['register-allocation', 'stack-layout', 'register-allocation', 'padding'])[(l_partkey + case when l_linenumber = 1 and l_partkey % 5 = 0 then 1 else 0 end) % 4 + 1] as cause, l_linenumber from lineitem join part on p_partkey = l_partkey),
k as (select address, list_distinct(list(cause) filter (where l_linenumber < 4 or address % 3 = 0)) as cs from c group by 1),
o as (select address, min(symbol) as symbol, cast(min(size) as bigint) as size, min(calls) as calls, min(score) as score, count(distinct unit) as n_units, min(unit) as first_unit from c where not exact and score < 100 and known = address and size = target_size and calls = target_calls group by 1),
x as (select o.*, case when cs is null or len(cs) = 0 or list_contains(cs, 'padding') then 'other-differences' when list_contains(cs, 'stack-layout') then 'frame-and-register' else 'register-only' end as category from o left join k using (address))"""


def _frames(spark, d):
    part = T(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("size"))
    x = T(spark, d, "lineitem").join(part, "l_partkey")
    k = F.col("l_partkey")
    candidates = x.select(
        (F.col("l_suppkey") % 10).alias("unit"), F.concat(F.lit("s"), k.cast("string")).alias("symbol"), k.alias("address"), F.when(k % 11 == 0, -1).otherwise(k).alias("known_address"), "size", F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("target_size"),
        (k % 5).alias("calls"), F.when(k % 13 == 0, 9).otherwise(k % 5).alias("target_calls"), (F.col("l_quantity").cast("long") * 2).alias("score"), (F.col("l_returnflag") == "A").alias("exact"),
    )
    causes = x.where((F.col("l_linenumber") < 4) | (k % 3 == 0)).select(k.alias("address"), _pick(["register-allocation", "stack-layout", "register-allocation", "padding"], k + F.when((F.col("l_linenumber") == 1) & (k % 5 == 0), 1).otherwise(0)).alias("cause"))
    return D.frame_census(candidates, causes)


@query("frame_census", f"with {_FRAMES} select address, symbol, category, size, calls, score, n_units, first_unit from x")
def frame_census(spark, d):
    """Parts as functions of equal size and calls on both sides, by what their causes amount to."""
    return _frames(spark, d)


@query("register_groups", f"with {_FRAMES} select first_unit as unit, count(*) as n, cast(sum(size) as bigint) as bytes from x where category = 'register-only' group by 1")
def register_groups(spark, d):
    return D.register_groups(_frames(spark, d))


@query(
    "flip_summary",
    """with f as (select l_partkey as symbol, count(distinct l_orderkey) as n from lineitem where l_suppkey % 3 = 0 and l_returnflag <> 'N' group by 1), u as (select l_partkey as symbol, cast(min(p_size) as bigint) as size, count(distinct l_suppkey) as units from lineitem join part on p_partkey = l_partkey group by 1)
select count(*) as functions, cast(coalesce(sum(size), 0) as bigint) as bytes, count(*) filter (where n = 1) as single_flip_functions, cast(coalesce(sum(n), 0) as bigint) as flips, cast(coalesce(sum(units), 0) as bigint) as unit_occurrences from u join f using (symbol)""",
)
def flip_summary(spark, d):
    """Parts with mirrored comparisons: lines as pairs of jumps of two causes."""
    x = T(spark, d, "lineitem")
    theirs = F.when(F.col("l_suppkey") % 3 == 0, "jg 5").otherwise("jge 5")
    cause = F.when(F.col("l_returnflag") == "N", "padding").otherwise("block-order")
    flips = x.where(D.comparison_flip(cause, F.lit("jl 4"), theirs)).select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("at"))
    sizes = T(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_size").cast("long").alias("size"))
    return D.flip_summary(flips, x.select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("unit")).join(sizes, "symbol"))


@query(
    "callee_ranks",
    """with f as (select l_orderkey as symbol, cast(sum(cast(l_quantity as bigint)) as bigint) as size, list_distinct(list(l_suppkey)) as cs, arg_min(l_suppkey, l_linenumber * 1000000 + l_partkey) as first_callee from lineitem where l_returnflag <> 'A' group by 1),
e as (select 'all' as which, symbol, size, unnest(cs) as callee from f union all select 'first', symbol, size, first_callee from f)
select which, callee, count(*) as n, cast(sum(size) as bigint) as bytes, min(symbol) as first from e group by 1, 2""",
)
def callee_ranks(spark, d):
    """Open functions and their bytes behind each callee, and behind each first one."""
    place = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    # of lines at one place the table's first counts, as in SQL; a line without a callee or a place is no first one
    at = F.when(F.col("l_suppkey").isNotNull() & place.isNotNull(), F.struct(place.alias("place"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    rows = T(spark, d, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("symbol"), "l_quantity", "l_suppkey", at.alias("at")).groupBy("symbol")
    rows = rows.agg(F.sum(F.col("l_quantity").cast("long")).alias("size"), F.collect_set("l_suppkey").alias("callees"), F.min_by("l_suppkey", "at").alias("first_callee"))
    one = lambda which, callees: D.callee_rank(rows, callees).select(F.lit(which).alias("which"), "callee", "n", "bytes", "first")
    return one("all", F.col("callees")).union(one("first", F.array("first_callee")))


# --- reports -------------------------------------------------------------------------------------


@query(
    "difference_report",
    """with f as (select s_suppkey as unit, 's' || s_nationkey as symbol, cast(floor(abs(s_acctbal)) as bigint) as bytes, s_acctbal > 0 as verified, s_suppkey % 4 = 0 as stub from supplier),
d as (select l_suppkey as unit, 's' || s_nationkey as symbol, (['call', 'constant', 'reference', 'indirect'])[l_linenumber % 4 + 1] as kind, (['different-callees', 'more', 'different-constants', 'different-references', 'count'])[l_partkey % 5 + 1] as class, case when l_partkey % 5 <> 1 or l_returnflag = 'A' then 'o' || l_partkey % 3 end as o, case when l_partkey % 5 <> 1 or l_returnflag <> 'A' then 't' || l_partkey % 2 end as t, l_partkey % 4 as n, l_partkey % 6 as m from lineitem join supplier on s_suppkey = l_suppkey),
e as (select unit, symbol, case when kind = 'call' and class = 'different-callees' then 'calls: ours also calls ' || o || ', the target ' || t when kind = 'call' then 'calls: ' || case when o is not null then 'ours' else 'the target' end || ' calls ' || coalesce(o, t) || ' more often'
  when kind = 'constant' and class = 'different-constants' then 'constants: ' || o || ' may stand for ' || t when kind = 'constant' then 'constants: ' || coalesce(o, t) || ' occurs ' || n || ' times in ours and ' || m || ' times in the target'
  when kind = 'reference' and class = 'different-references' then 'references: ' || o || ' may stand for ' || t when kind = 'reference' and class = 'count' then 'references: ' || coalesce(o, t) || ' occurs ' || n || ' times in ours and ' || m || ' times in the target'
  when kind = 'reference' then 'references: ' || case when o is not null then 'ours' else 'the target' end || ' uses ' || coalesce(o, t) || ' more often' else 'indirect calls: ours ' || n || ', the target ' || m end as said from d),
c as (select unit, symbol, said, count(*) as n from e group by 1, 2, 3),
l as (select unit, 0 as rank, '' as name, lpad(cast(bytes as varchar), 7, ' ') || 'B  ' || unit || '  ' || symbol || case when not verified and stub then '  [unverified address, stub]' when not verified then '  [unverified address]' when stub then '  [stub]' else '' end as line from f
  union all select unit, 1, said, '    ' || said || case when n > 1 then ' x' || n else '' end from c)
select unit, count(*) as n_lines, string_agg(line, chr(10) order by rank, name) as text from l group by 1""",
)
def difference_report(spark, d):
    """Suppliers as units of one function, their lines as its differences."""
    functions = T(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("symbol"), F.floor(F.abs("s_acctbal")).cast("long").alias("bytes"), (F.col("s_acctbal") > 0).alias("verified"), (F.col("s_suppkey") % 4 == 0).alias("stub"))
    k = F.col("l_partkey")
    one_sided = k % 5 == 1
    found = T(spark, d, "lineitem").join(functions.select(F.col("unit").alias("l_suppkey"), "symbol"), "l_suppkey").select(
        F.col("l_suppkey").alias("unit"), "symbol", _pick(["call", "constant", "reference", "indirect"], F.col("l_linenumber")).alias("kind"), _pick(["different-callees", "more", "different-constants", "different-references", "count"], k).alias("class"),
        F.when(~one_sided | (F.col("l_returnflag") == "A"), F.concat(F.lit("o"), (k % 3).cast("string"))).alias("ours"), F.when(~one_sided | (F.col("l_returnflag") != "A"), F.concat(F.lit("t"), (k % 2).cast("string"))).alias("theirs"), (k % 4).alias("ours_n"), (k % 6).alias("theirs_n"),
    )
    return render.page([R.differences(functions, found)], ["unit"], ["rank", "name"])


@query(
    "statics_report",
    """with z as (select l_suppkey as unit, '.data' || l_linenumber % 3 as section, 'v' || l_partkey as symbol, cast(min(l_quantity) as bigint) as size, case when l_partkey % 17 = 0 then 'target-pointer-run' else 'neighbours' end as basis from lineitem where l_returnflag = 'A' group by 1, 2, 3, l_partkey),
s as (select unit, section, unit % 3 = 0 as differs, string_agg(symbol, ' -> ' order by symbol) as defs from z group by 1, 2),
sh as (select s.* from s where differs or exists (select 1 from z where z.unit = s.unit and z.section = s.section and basis = 'target-pointer-run')),
o as (select l_suppkey as unit, 'o' || l_partkey as symbol, min(l_orderkey) as p0, max(l_orderkey) as t_at, cast(min(l_quantity) as bigint) as size, cast(max(l_quantity) as bigint) as t_size, (['same-layout', 'layout-differs', 'size-differs', 'size-unverified', 'ambiguous', 'unmapped'])[l_partkey % 6 + 1] as state, count(*) as n, count(*) filter (where l_linestatus = 'O') as m from lineitem group by 1, 2, l_partkey),
l as (select unit, 1 as rank, section as name, '' as place, '  ' || section || ': order differs: ' || differs || '; definitions: ' || defs as line from sh
  union all select z.unit, 1, z.section, ' ' || symbol, '    ' || symbol || ': size ' || size || ' (' || basis || ')' from z join sh on sh.unit = z.unit and sh.section = z.section
  union all select unit, 2, symbol, '', '  ' || symbol || ': .bss+0x' || printf('%x', p0) || '/' || size || ' -> .bss+0x' || printf('%x', t_at) || '/' || t_size || ' (' || state || ', ' || n || ' references, ' || m || ' outliers)' from o where state in ('layout-differs', 'size-differs', 'size-unverified', 'ambiguous'))
select unit, count(*) as n_lines, string_agg(line, chr(10) order by rank, name, place) as text from l group by 1""",
)
def statics_report(spark, d):
    """Suppliers as units, their lines as static data."""
    x = T(spark, d, "lineitem").withColumnRenamed("l_suppkey", "unit")
    k = F.col("l_partkey")
    named = lambda p: F.concat(F.lit(p), k.cast("string")).alias("symbol")
    basis = F.when(k % 17 == 0, "target-pointer-run").otherwise("neighbours").alias("basis")
    sizes = x.where("l_returnflag = 'A'").groupBy("unit", F.concat(F.lit(".data"), (F.col("l_linenumber") % 3).cast("string")).alias("section"), named("v"), basis).agg(F.min("l_quantity").cast("long").alias("size"))
    sections = sizes.groupBy("unit", "section").agg(F.array_sort(F.collect_list("symbol")).alias("definitions")).withColumn("order_differs", F.col("unit") % 3 == 0)
    state = _pick(["same-layout", "layout-differs", "size-differs", "size-unverified", "ambiguous", "unmapped"], k).alias("state")
    bss = F.lit(".bss")
    objects = x.groupBy("unit", named("o"), state).agg(
        F.min("l_orderkey").alias("at"), F.max("l_orderkey").alias("target_at"), F.min("l_quantity").cast("long").alias("size"), F.max("l_quantity").cast("long").alias("target_size"), F.count(F.lit(1)).alias("n_references"), F.count_if(F.col("l_linestatus") == "O").alias("n_outliers")
    ).withColumns({"section": bss, "target_section": bss})
    return render.page([R.statics(sections, sizes, objects)], ["unit"], ["rank", "name", "place"])


@query(
    "decision_report",
    """with f as (select o_custkey as unit, o_orderkey as pos, case when o_orderstatus <> 'P' then 'pass' || o_orderkey % 3 end as p, case when o_orderkey % 5 = 0 then null else 'a.cc' end as path, case when o_orderkey % 4 = 0 then 'observed-ssa-pair' when o_orderkey % 4 = 1 then 'none' end as tree, case when o_orderkey % 8 = 1 then 'two pairs' end as reason, o_orderpriority as cause from orders),
o as (select l_orderkey as pos, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as place, 'x_' || l_partkey as name, case when l_returnflag = 'A' then 'tree' || l_linenumber end as made, case when l_returnflag = 'N' then 'function-entry' end as origin, l_linenumber as ln, case when l_linestatus = 'O' then 'y_' || l_suppkey end as recycled from lineitem),
q as (select unit, pos from f where p is not null and tree = 'observed-ssa-pair'),
l as (select unit, pos, 0 as rank, 0 as place, case when p is null then '  +0x' || printf('%x', pos) || ': ' || cause || ': no traced instruction' else '  +0x' || printf('%x', pos) || ': ' || p || ' (move), ' || coalesce(path, '?') || ':7: t' end as line from f
  union all select unit, pos, 1, 0, '    tree unresolved: ' || coalesce(reason, 'no unique pair') from f where p is not null and tree = 'none'
  union all select unit, pos, 2, place * 2, case when made is not null then '    ' || name || ' created in ' || made || ': d' else '    ' || name || ' is there at entry: b.h:' || ln end from o join q using (pos) where made is not null or origin is not null
  union all select unit, pos, 2, place * 2 + 1, '      version recycled from ' || recycled from o join q using (pos) where recycled is not null
  union all select unit, pos, 3, place, case when place % 2 = 0 then '    order reverses in p1: ' || name || ' -> z' else '    comparison mirrored in p1: z' end from o join q using (pos))
select unit, count(*) as n_lines, string_agg(line, chr(10) order by pos, rank, place) as text from l group by 1""",
)
def decision_report(spark, d):
    """Customers as units, orders as differences that a pass decided, lines as operands and changes."""
    k = F.col("o_orderkey")
    findings = T(spark, d, "orders").select(
        F.col("o_custkey").alias("unit"), k.alias("at"), F.col("o_orderpriority").alias("cause"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("pass"), (k % 3).cast("string"))).alias("pass"), F.lit("move").alias("kind"), F.when(k % 5 != 0, "a.cc").alias("path"), F.lit(7).alias("line_no"), F.lit("t").alias("text"),
        F.when(k % 4 == 0, "observed-ssa-pair").when(k % 4 == 1, "none").alias("tree"), F.when(k % 8 == 1, "two pairs").alias("reason"),
    )
    w = Window.partitionBy("at").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    x = T(spark, d, "lineitem").withColumn("at", F.col("l_orderkey")).join(findings.select("unit", "at"), "at").withColumn("place", F.row_number().over(w)).withColumn("name", F.concat(F.lit("x_"), F.col("l_partkey").cast("string")))
    operands = x.select(
        "unit", "at", "place", "name", F.when(F.col("l_returnflag") == "N", "function-entry").alias("origin"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("tree"), F.col("l_linenumber").cast("string"))).alias("creation_pass"), F.lit("d").alias("definition"), F.lit("b.h").alias("path"), F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("y_"), F.col("l_suppkey").cast("string"))).alias("recycled_from"),
    )
    changes = x.select("unit", "at", "place", F.when(F.col("place") % 2 == 0, "order").otherwise("orientation").alias("kind"), F.lit("p1").alias("pass"), F.col("name").alias("before"), F.lit("z").alias("after"))
    return render.page([R.decisions(findings, operands, changes)], ["unit"], ["at", "rank", "place"])


# --- readers -------------------------------------------------------------------------------------


@query("dump_files", "select page_id % 40 as unit, sha256(string_agg(html || chr(10), '' order by page_id)) as sha256, cast(sum(length(html) + 1) as int) as n_chars from pages group by 1")
def dump_files(spark, d):
    """Pages written as forty files and read back as dumps, each with the hash of its bytes."""
    at = scratch.folder(spark, "dumps")
    pages = T(spark, d, "pages").select((F.col("page_id") % 40).alias("unit"), "page_id", "html")
    pages.repartition("unit").sortWithinPartitions("unit", "page_id").select("unit", "html").write.partitionBy("unit").text(at)
    files = dumps.dump_files(spark, at).where(F.col("dump").contains("/part-"))
    return files.select(F.regexp_extract("dump", r"/unit=(\d+)/", 1).cast("long").alias("unit"), "sha256", F.length("text").alias("n_chars"))


@query("rule_catalog", "select 'gcc-' || n_nationkey as base, 'gcc-' || n_nationkey || '/' || n_name as first, count(*) as n from nation group by 1, 2")
def rule_catalog(spark, d):
    """Nations as rule bases of one rule each, written as files: the catalog of bases, and what each holds."""
    at = scratch.folder(spark, "rule-catalog")
    name = F.concat(F.lit("gcc-"), F.col("n_nationkey").cast("string"))
    text = F.format_string('[[idiom]]\nid = "%s/%s"\ncause = "padding"', name, "n_name")
    T(spark, d, "nation").select(name.alias("base"), text.alias("value")).write.partitionBy("base").text(at)
    files = tables.rule_files(spark, at, "part-*")
    return tables.rule_bases(files).groupBy("base").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
