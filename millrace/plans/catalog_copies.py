"""Registered queries of emitted copies: lines, parts and suppliers stand in for functions, extents and a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import render
from millrace.operators import copies as C
from millrace.plans import bindings as B
from millrace.plans.catalog import query

T = B.table
_STATES = ["placed", "unplaced", None]


def inputs(spark, d) -> dict:
    """Units are suppliers modulo 20; a part number modulo 97 is a symbol; part numbers are addresses."""
    line = T(spark, d, "lineitem")
    unit, k = (F.col("l_suppkey") % 20).alias("unit"), F.col("l_partkey") % 97
    symbol = F.when(k == 0, F.concat(F.lit("_GLOBAL__I"), (F.col("l_suppkey") % 3).cast("string"))).otherwise(F.concat(F.lit("_Z"), k.cast("string")))
    made = line.select(unit, k.alias("k"), symbol.alias("symbol"), F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_partkey", "l_linestatus")
    made = made.where("q > 12")
    ours = made.groupBy("unit", "symbol").agg(F.min("q").alias("size"), F.max("k").alias("k"))
    state = F.when((F.col("k") + F.col("unit")) % 3 == 0, "placed").when((F.col("k") + F.col("unit")) % 3 == 1, "unplaced")
    ours = ours.withColumn("state", state)
    rows = ours.where("state = 'placed'").select("unit", "symbol", (F.col("unit") * 50 + F.col("k") % 50).alias("address"), "size")
    part = T(spark, d, "part").select(F.col("p_partkey").alias("address"), F.col("p_size").cast("long").alias("size"), F.when(F.col("p_partkey") % 9 == 0, "thunk").otherwise("fde").alias("kind"), "p_partkey")
    named = part.where("address % 4 = 0").select("address", F.concat(F.lit("_Z"), (F.col("address") % 97).cast("string")).alias("symbol"))
    spans = T(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("unit")).distinct().select("unit", (F.col("unit") * 50).alias("low"), (F.col("unit") * 50 + 40).alias("high"))
    credit = T(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("unit"), F.when(F.col("s_nationkey") == 0, "_GLOBAL__I9").otherwise(F.concat(F.lit("_Z"), (F.col("s_suppkey") % 150).cast("string"))).alias("symbol"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("marker")).distinct()
    call = line.select(unit, F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("function"), F.col("l_partkey").alias("p"), F.col("l_linestatus").alias("side"), "l_returnflag")
    direct = call.where("l_returnflag <> 'A'")
    name = F.when((F.col("side") == "F") & (F.col("p") % 3 == 0), F.concat(F.lit("sub_"), F.lower(F.hex(F.col("p") % 400)))).otherwise(F.concat(F.lit("_Z"), (F.col("p") % 97).cast("string")))
    direct = direct.groupBy("side", "unit", "function", name.alias("callee")).agg(F.count(F.lit(1)).alias("n"))
    indirect = call.groupBy("side", "unit", "function").agg(F.count_if(F.col("l_returnflag") == "A").alias("n"))
    of = lambda df, side: df.where(F.col("side") == side).drop("side")
    calls = {name: of(direct, side) for name, side in (("our_calls", "O"), ("their_calls", "F"))}
    return {
        "ours": ours.drop("k"), "rows": rows, "extents": part.drop("p_partkey"), "named": named, "spans": spans, "credit": credit,
        "exact": rows.where("size % 2 = 0").select("unit", "symbol"), **calls, "our_indirect": of(indirect, "O"), "their_indirect": of(indirect, "F"),
    }


_IN = """line as (select l_suppkey % 20 as unit, l_partkey % 97 as k, case when l_partkey % 97 = 0 then '_GLOBAL__I' || l_suppkey % 3 else '_Z' || l_partkey % 97 end as symbol, cast(l_quantity as bigint) as q, l_partkey as p, l_linestatus as side, l_returnflag as flag from lineitem),
ours as (select unit, symbol, min(q) as size, max(k) as k, case when (max(k) + unit) % 3 = 0 then 'placed' when (max(k) + unit) % 3 = 1 then 'unplaced' end as state from line where q > 12 group by 1, 2),
rws as (select unit, symbol, unit * 50 + k % 50 as address, size from ours where state = 'placed'),
ext as (select p_partkey as address, cast(p_size as bigint) as size, case when p_partkey % 9 = 0 then 'thunk' else 'fde' end as kind, case when p_partkey % 4 = 0 then '_Z' || p_partkey % 97 end as symbol from part),
names as (select symbol, max(address) as address from ext where symbol is not null group by 1),
spans as (select distinct s_suppkey % 20 as unit from supplier),
credit as (select distinct s_suppkey % 20 as unit, case when s_nationkey = 0 then '_GLOBAL__I9' else '_Z' || s_suppkey % 150 end as symbol, 'n' || s_nationkey as marker from supplier),
cl as (select unit, 'f' || p % 5 as function, side, flag, case when side = 'F' and p % 3 = 0 then 'sub_' || printf('%x', p % 400) else '_Z' || p % 97 end as callee, case when side = 'F' and p % 3 = 0 then p % 400 end as spelled from line),
direct as (select c.side, unit, function, callee, coalesce(any_value(spelled), any_value(n.address)) as address, count(*) as n from cl c left join names n on n.symbol = c.callee where flag <> 'A' group by 1, 2, 3, 4),
called as (select unit, address, cast(sum(n) as bigint) as called from direct where side = 'F' and address is not null group by 1, 2),
free as (select distinct h.*, coalesce(called, 0) as called from (
  select s.unit, e.* from ext e join spans s on e.address >= s.unit * 50 and e.address < s.unit * 50 + 40 union select c.unit, e.* from called c join ext e using (address) where e.symbol is null) h
  left join called c using (unit, address) where not exists (select 1 from rws r where r.unit = h.unit and r.address = h.address)),
homeless as (select o.unit, o.symbol, o.size, case when exists (select 1 from credit c where c.symbol = o.symbol and c.unit = o.unit) then 'expected' when exists (select 1 from credit c where c.symbol = o.symbol) then 'elsewhere'
  when exists (select 1 from free f where f.unit = o.unit and f.size = o.size) then 'possible-home' else 'surplus' end as verdict,
  (select count(distinct c.unit) from credit c where c.symbol = o.symbol and c.unit <> o.unit) as credited, (select count(*) from free f where f.unit = o.unit and f.size = o.size) as n_homes from ours o where state = 'unplaced'),
emit as (select symbol, count(*) as n from ours group by 1), ex as (select symbol, count(*) as n from rws where size % 2 = 0 group by 1),
miss as (select c.*, e.symbol is not null as missing from credit c left join emit e using (symbol) where not exists (select 1 from ours o where o.unit = c.unit and (o.symbol = c.symbol or (o.symbol like '\\_GLOBAL\\_\\_I%' escape '\\' and c.symbol like '\\_GLOBAL\\_\\_I%' escape '\\'))))"""
_IN = _IN.replace("\\\\", "\\")


@query("unplaced_copies", f"with {_IN} select h.*, e.n - 1 as emitted_elsewhere, coalesce(x.n, 0) as exact_elsewhere from homeless h join emit e using (symbol) left join ex x using (symbol)")
def unplaced_copies(spark, d):
    """Copies without a place: verdicts from the map and the free extents of the unit, and what other units show of them."""
    i = inputs(spark, d)
    return C.elsewhere(C.unplaced(i["ours"], _free(i), i["credit"]), i["ours"], i["exact"])


def _free(i):
    calls = C.addressed(i["their_calls"], i["named"]).where("address is not null").groupBy("unit", "address").agg(F.sum("n").alias("called"))
    return C.homes(i["extents"], i["spans"], i["rows"], i["named"], calls, 40)


@query("target_only_copies", f"with {_IN} select unit, address, size, kind, symbol, called from free f where not exists (select 1 from homeless h where h.unit = f.unit and h.size = f.size)")
def target_only_copies(spark, d):
    """Extents that no copy of ours can stand for."""
    i = inputs(spark, d)
    free = _free(i)
    return C.target_only(free, C.unplaced(i["ours"], free, i["credit"])).select("unit", "address", "size", "kind", "symbol", "called")


@query("differing_copies", f"with {_IN} select r.unit, r.symbol, r.size as ours, e.size as target from rws r join ext e using (address) where r.size <> e.size")
def differing_copies(spark, d):
    i = inputs(spark, d)
    return C.differing(i["rows"], i["extents"])


@query("credited_copies", f"with {_IN} select unit, symbol, marker, missing from miss")
def credited_copies(spark, d):
    """Rows of the map without a copy of ours; set-up functions go by their kind."""
    i = inputs(spark, d)
    return C.credited_only(i["credit"], i["ours"])


_CALLS = """p as (select unit, function, callee, any_value(address) as address, cast(sum(case when side = 'O' then n else 0 end) as bigint) as o, cast(sum(case when side = 'F' then n else 0 end) as bigint) as t from direct group by 1, 2, 3),
r as (select unit, function, 'ours' as side, callee, coalesce((select address from names n where n.symbol = callee), (select max(address) from rws where rws.unit = p.unit and rws.symbol = callee)) as address, o - t as n from p where o > t
  union all select unit, function, 'theirs', callee, address, t - o from p where t > o),
w as (select *, coalesce(sum(n) over (partition by unit, function, address, side order by callee rows between unbounded preceding and 1 preceding), 0) as before,
  least(sum(case when side = 'ours' then n else 0 end) over (partition by unit, function, address), sum(case when side = 'theirs' then n else 0 end) over (partition by unit, function, address)) as gone from r),
k as (select unit, function, side, callee, address, n - greatest(0, least(n, case when address is null then 0 else gone end - before)) as n from w),
dif as (select unit, function, side, case when side = 'theirs' and address is not null then coalesce((select max(symbol) from ext e where e.address = k.address), 'sub_' || printf('%x', address)) else callee end as callee, cast(sum(n) as bigint) as n from k where n > 0 group by 1, 2, 3, 4)"""


@query("call_differences", f"with {_IN}, {_CALLS} select * from dif")
def call_differences(spark, d):
    """Direct calls of one side, after names and then addresses cancel."""
    i = inputs(spark, d)
    return C.call_differences(i["our_calls"], i["their_calls"], i["named"], i["rows"])


@query(
    "copy_report",
    f"""with {_IN}, {_CALLS}, ind as (select unit, function, count(*) filter (where flag = 'A' and side = 'O') as o, count(*) filter (where flag = 'A' and side = 'F') as t from cl group by 1, 2 having bool_or(side = 'O') and bool_or(side = 'F')),
note as (select o.unit, o.symbol, case when e.n > 1 then '; emitted in ' || (e.n - 1) || ' other units' else '' end || case when coalesce(x.n, 0) - coalesce(own.n, 0) > 0 then ', exact in ' || (x.n - coalesce(own.n, 0)) else '' end as said
  from ours o join emit e using (symbol) left join ex x using (symbol) left join (select unit, symbol, 1 as n from rws where size % 2 = 0) own on own.unit = o.unit and own.symbol = o.symbol),
l as (
  select r.unit, 1 as rank, r.symbol as name, 'different definition: ' || r.symbol || ', ours ' || r.size || ' bytes, target ' || e.size || said as line from rws r join ext e using (address) join note n on n.unit = r.unit and n.symbol = r.symbol where r.size <> e.size
  union all select h.unit, 2, h.symbol, case verdict when 'expected' then 'unplaced; the map credits this unit' when 'elsewhere' then 'unplaced; the map credits only other units' when 'possible-home' then 'unplaced; an unnamed extent of its size is in the span' else 'emitted; no trace of a copy out of line anywhere' end
    || case when credited > 0 then ' (' || credited || ')' else '' end || ': ' || h.symbol || ', ' || size || ' bytes' || said from homeless h join note n on n.unit = h.unit and n.symbol = h.symbol
  union all select unit, 3, printf('%016x', address), 'target only at 0x' || printf('%x', address) || ', ' || size || ' bytes: ' || coalesce(symbol, 'unnamed') || case when called > 0 then ', called ' || called || ' times' else '' end from free f where not exists (select 1 from homeless h where h.unit = f.unit and h.size = f.size)
  union all select unit, 4, symbol, 'credited by ' || marker || ', not emitted: ' || symbol from miss where missing
  union all select unit, case side when 'ours' then 5 else 6 end, function || ' ' || callee, function || case side when 'ours' then ': we call ' else ': the target calls ' end || callee || ' ' || n || ' times more' from dif
  union all select unit, 7, function, function || ': indirect calls, ours ' || o || ', target ' || t from ind where o <> t)
select unit, count(*) as n_lines, string_agg(line, chr(10) order by rank, name, line) as text from l group by 1""",
)
def copy_report(spark, d):
    """Every unit's findings as a page."""
    i = inputs(spark, d)
    free = _free(i)
    homeless = C.unplaced(i["ours"], free, i["credit"])
    told = lambda found: C.elsewhere(found, i["ours"], i["exact"])
    calls = C.call_differences(i["our_calls"], i["their_calls"], i["named"], i["rows"])
    lines = C.report(told(C.differing(i["rows"], i["extents"])), told(homeless), C.target_only(free, homeless), C.credited_only(i["credit"], i["ours"]), calls, C.indirect_differences(i["our_indirect"], i["their_indirect"]))
    return render.page([lines], ["unit"], ["rank", "name"])
