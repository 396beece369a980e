"""Registered queries of findings, inventories and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import render
from millrace.functions import text as X
from millrace.operators import findings as D
from millrace.operators import inventories as V
from millrace.plans import bindings as B
from millrace.plans.catalog import query

T = B.table
_CAUSES = ["register-allocation", "instruction-order", "block-order", "instruction-selection", "inlining", "immediate-or-reloc", "reference", "struct-layout", "padding", "unknown"]
_CAUSE = "(['" + "', '".join(_CAUSES) + "'])[l_partkey % 10 + 1]"
_KIND = """case {c} when 'register-allocation' then 'register-choice' when 'instruction-order' then 'instruction-order' when 'block-order' then 'block-order' when 'instruction-selection' then 'instruction-selection'
  when 'inlining' then 'calls' when 'immediate-or-reloc' then 'data' when 'reference' then 'data' when 'struct-layout' then 'data' when 'padding' then 'padding' else 'other' end"""


def _findings(spark, d):
    """Line items as findings of their order: a cause by part, a flip by supplier, rows by quantity."""
    cause = F.element_at(F.array(*map(F.lit, _CAUSES)), (F.col("l_partkey") % 10 + 1).cast("int"))
    return T(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), cause.alias("cause"), (F.col("l_suppkey") % 13 == 0).alias("flip"), F.col("l_quantity").cast("long").alias("rows"))


@query(
    "finding_kinds",
    f"""select case when l_suppkey % 13 = 0 then 'comparison-flip' else {_KIND.format(c=_CAUSE)} end as kind, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as n_rows from lineitem group by 1""",
)
def finding_kinds(spark, d):
    return _findings(spark, d).groupBy(D.finding_kind(F.col("cause"), F.col("flip")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("n_rows"))


@query(
    "comparison_flips",
    """select o_orderkey as k, o_orderkey % 7 in (0, 1) and o_custkey % 3 <> 2 as flip from orders""",
)
def comparison_flips(spark, d):
    """Rendered pairs of three causes: compared values swapped, a mirrored jump elsewhere, an opposite jump, equality, a sum swapped, other operands, a comparison of one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (F.concat(F.lit("a"), (c % n).cast("string")) for n in (3, 5))
    pair = lambda name, *args: F.concat(F.lit(name + " "), F.array_join(F.array(*args), ", "))
    b, e = F.lit("b"), F.lit("e")
    cases = [("cmp", "cmp", (x, y), (y, x)), ("jl", "jg", (x,), (y,)), ("jl", "jge", (x,), (x,)), ("je", "je", (x,), (x,)), ("add", "add", (x, y), (y, x)), ("cmp", "cmp", (x, b), (x, e)), ("cmp", "cmp", (x,), (x,))]
    at = (k % len(cases) + 1).cast("int")
    ours, theirs = (F.element_at(F.array(*[pair(case[i], *case[i + 2]) for case in cases]), at) for i in (0, 1))
    cause = F.element_at(F.array(*map(F.lit, ["operand-order", "block-order", "register-allocation"])), (c % 3 + 1).cast("int"))
    return T(spark, d, "orders").select(k.alias("k"), D.comparison_flip(cause, ours, theirs).alias("flip"))


_NAMES = "(['_Unwind_Resume', '_ZdlPv', '_ZN1AD1Ev', '_ZN1AD2Ev', '_ZN1A3runEv'])[l_partkey % {n} + 1]"


def _callees(n: int):
    return F.element_at(F.array(*map(F.lit, ["_Unwind_Resume", "_ZdlPv", "_ZN1AD1Ev", "_ZN1AD2Ev", "_ZN1A3runEv"])), (F.col("l_partkey") % n + 1).cast("int"))


@query(
    "cleanup_only",
    f"""with c as (select l_orderkey, {_NAMES.format(n=5)} as s, l_partkey from lineitem)
select l_orderkey, bool_and(s <> '_ZN1A3runEv') as cleanup, count(*) filter (where s <> '_ZN1A3runEv') as n_cleanup from c group by 1""",
)
def cleanup_only(spark, d):
    per = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_callees(5)).alias("callees"))
    return per.select("l_orderkey", D.cleanup_only(F.col("callees")).alias("cleanup"), F.size(F.filter("callees", D.is_cleanup)).cast("long").alias("n_cleanup"))


def _differences(spark, d):
    """Line items as differences of their order."""
    kinds = F.element_at(F.array(*map(F.lit, ["call", "constant", "reference", "indirect"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    cls = F.when(F.col("l_returnflag") == "A", "different-callees").otherwise("count")
    return T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), kinds.alias("kind"), cls.alias("class"), (F.col("l_linenumber") % 3).cast("long").alias("ours"), (F.col("l_partkey") % 3).alias("theirs"), F.array(_callees(5)).alias("callees"), (F.col("l_linestatus") == "O").alias("count_differs")
    )


_PATTERNS = f"""d as (select l_orderkey as key, (['call', 'constant', 'reference', 'indirect'])[l_suppkey % 4 + 1] as kind, l_returnflag = 'A' as other, l_linestatus = 'O' as counts, l_linenumber % 3 as o, l_partkey % 3 as t, {_NAMES.format(n=5)} <> '_ZN1A3runEv' as cleanup from lineitem),
e as (select *, kind = 'call' and not cleanup and (other or counts) as counted from d),
p as (select key, cast(sum(case when counted then case when other then o + t else 1 end when kind = 'indirect' then abs(o - t) else 0 end) as bigint) as n_calls, count(*) filter (where kind in ('constant', 'reference')) as n_data,
  count(*) filter (where kind = 'call' and not counted) as n_distribution, bool_or(counted or kind <> 'call') as points_to_source from e group by key)"""


@query("pattern_counts", f"with {_PATTERNS} select * from p")
def pattern_counts(spark, d):
    return D.pattern_counts(_differences(spark, d), ["key"])


@query(
    "value_differences",
    """select l_orderkey, count(*) as n from lineitem where l_suppkey % 4 = 1 and l_returnflag <> 'A' and l_linenumber <> 3 and not (l_partkey % 5 - 1 between -1 and 1 and l_linenumber - 2 between -1 and 1) group by 1""",
)
def value_differences(spark, d):
    """Orders' constants that differ in more than small values, away from the stack pointer."""
    kind = F.when(F.col("l_suppkey") % 4 == 1, "constant").otherwise("call")
    cls = F.when(F.col("l_returnflag") != "A", "different-constants").otherwise("same")
    site = F.array(F.when(F.col("l_linenumber") == 3, "rsp").otherwise("rax"))
    tells = D.differs_in_value(kind, cls, F.col("l_partkey") % 5 - 1, F.col("l_linenumber") - 2, site)
    return T(spark, d, "lineitem").where(tells).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


_KINDS = f"""{_PATTERNS}, f as (select l_orderkey as key, {_CAUSE} as cause, l_suppkey % 13 = 0 as flip, cast(l_quantity as bigint) as rows, l_returnflag as detail, l_linenumber = l_orderkey % 7 and l_quantity >= 2 as checked from lineitem),
a as (select key, case when flip then 'comparison-flip' else {_KIND.format(c="cause")} end as kind, detail, rows - checked::int as n from f where cause <> 'inlining' union all select key, 'enum-check', detail, 1 from f where cause <> 'inlining' and checked),
t as (select f.key, sum(rows) as rows, any_value(n_calls) as c from f join p using (key) where cause = 'inlining' and n_calls > 0 group by f.key),
b as (select key, 'calls' as kind, null as detail, least(rows, c) as n from t union all select key, 'block-order', null, rows - least(rows, c) from t
  union all select f.key, case when n_distribution > 0 then 'inline-distribution' else 'block-order' end, detail, rows from f left join p using (key) where cause = 'inlining' and coalesce(n_calls, 0) = 0),
k as (select key, kind, detail, cast(sum(n) as bigint) as n from (select * from a union all select * from b) group by all having sum(n) > 0)"""


def _placed(spark, d):
    """``_findings`` with the offsets of up to four of their rows and a detail; a check in each order."""
    cause = F.element_at(F.array(*map(F.lit, _CAUSES)), (F.col("l_partkey") % 10 + 1).cast("int"))
    first = 10 * F.col("l_linenumber")
    found = T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), cause.alias("cause"), (F.col("l_suppkey") % 13 == 0).alias("flip"), F.col("l_quantity").cast("long").alias("rows"), F.col("l_returnflag").alias("detail"), F.sequence(first, first + 3).alias("offsets")
    )
    checks = T(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (10 * (F.col("o_orderkey") % 7) + 1).alias("offset"))
    return found, checks


@query("kind_rows", f"with {_KINDS} select key, kind, cast(sum(n) as bigint) as n from k group by 1, 2")
def kind_rows(spark, d):
    found, checks = _placed(spark, d)
    return D.kind_rows(found, "key", D.pattern_counts(_differences(spark, d), ["key"]), checks)


@query("kind_evidence", f"with {_KINDS} select key, kind, detail, n from k")
def kind_evidence(spark, d):
    """The same with what each count is evidenced by."""
    found, checks = _placed(spark, d)
    return D.kind_evidence(found, "key", D.pattern_counts(_differences(spark, d), ["key"]), checks)


@query(
    "pattern_signals",
    f"""with {_PATTERNS}, s as (select key, 'calls-constants' as g from p where points_to_source union select l_orderkey, 'value-difference' from lineitem where l_quantity > 45 union select l_orderkey, 'signedness' from lineitem where l_discount > 0.08 union select o_orderkey, 'enum-switch' from orders where o_orderstatus = 'P')
select key, string_agg(g, ',' order by g) as signals, cast(count(*) as int) as n from s group by key""",
)
def pattern_signals(spark, d):
    """Names of the detectors that found each order."""
    x = T(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")
    counted = D.pattern_counts(_differences(spark, d), ["key"]).where("points_to_source")
    enum = T(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    return D.signals({"calls-constants": counted, "value-difference": x.where("l_quantity > 45"), "signedness": x.where("l_discount > 0.08"), "enum-switch": enum}, "key")


def _explained(spark, d):
    n = F.count(F.lit(1))
    rows = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("explained"), F.count_if(F.col("l_returnflag") != "N").alias("differing"), n.alias("pairs"), F.sum("l_quantity").cast("long").alias("size"))
    return D.explained(rows, "explained", "differing")


_EXPLAINED = """x as (select l_orderkey, count(*) filter (where l_returnflag = 'R') as explained, count(*) filter (where l_returnflag <> 'N') as differing, count(*) as pairs, cast(sum(l_quantity) as bigint) as size from lineitem group by 1)"""


@query("explained_rank", f"with {_EXPLAINED} select *, case when differing = 0 then 1.0 else explained / differing end as explanation, explained = differing as only from x order by explanation desc, explained desc, size desc, l_orderkey limit 100")
def explained_rank(spark, d):
    """A top-k report: the orders whose differences are explained best, five keys deep."""
    return D.by_explanation(_explained(spark, d), "explained", "size", "l_orderkey", "l_orderkey").limit(100)


@query("explained_summary", f"with {_EXPLAINED} select count(*) as functions, cast(sum(pairs) as bigint) as pairs, count(*) filter (where explained = differing) as only_explained from x")
def explained_summary(spark, d):
    return _explained(spark, d).agg(F.count(F.lit(1)).alias("functions"), F.sum("pairs").alias("pairs"), F.count_if("only").alias("only_explained"))


@query(
    "cause_totals",
    f"""with f as (select {_CAUSE} as cause, l_quantity from lineitem) select cause, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as bytes from f group by 1""",
)
def cause_totals(spark, d):
    return D.cause_totals(_findings(spark, d), "cause", "rows")


@query(
    "cause_sets",
    """with c as (select l_orderkey, l_suppkey % 10 as u, (['register-allocation', 'stack-layout', 'other'])[l_partkey % 3 + 1] as cause, l_quantity from lineitem),
s as (select l_orderkey, min(u) as u, list_distinct(list(cause)) as cs, cast(sum(cast(l_quantity as bigint)) as bigint) as bytes from c group by 1),
k as (select *, case when list_contains(cs, 'other') then 'other-differences' when list_contains(cs, 'stack-layout') then 'frame-and-register' else 'register-only' end as category from s)
select category, u, count(*) as n, cast(sum(bytes) as bigint) as bytes from k group by 1, 2""",
)
def cause_sets(spark, d):
    """Orders by what their set of causes amounts to, per unit."""
    cause = F.element_at(F.array(F.lit("register-allocation"), F.lit("stack-layout"), F.lit("other")), (F.col("l_partkey") % 3 + 1).cast("int"))
    per = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_suppkey") % 10).alias("u"), F.collect_set(cause).alias("causes"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return per.groupBy(D.cause_class(F.col("causes")).alias("category"), "u").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


# --- inventories -----------------------------------------------------------------------------------


def _inventory(spark, d):
    return T(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderstatus") == "F").alias("exact"))


def _found(spark, d):
    """Orders with a returned line, by the lines' quantity."""
    return T(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))


_INVENTORY = """inv as (select o_orderkey as key, cast(floor(o_totalprice) as bigint) as size, o_orderstatus = 'F' as exact from orders),
fnd as (select l_orderkey as key, cast(sum(cast(l_quantity as bigint)) as bigint) as found_size from lineitem where l_returnflag = 'R' group by 1),
j as (select i.key as ik, i.size, i.exact, f.key as fk, f.found_size from inv i full join fnd f on f.key = i.key),
parts as (select case when ik is null then 'untracked' when exact then case when fk is not null then 'overlap' else 'exact' end when fk is not null then 'classified' else 'missing' end as part, count(*) as n, cast(sum(coalesce(size, found_size)) as bigint) as bytes from j group by 1)"""


@query("reconcile_parts", f"with {_INVENTORY} select * from parts")
def reconcile_parts(spark, d):
    return V.reconcile(_inventory(spark, d), _found(spark, d), "key")


@query(
    "reconcile_balance",
    f"""with {_INVENTORY}, t as (select sum(cast(floor(o_totalprice) as bigint)) as total, sum(case when o_orderstatus = 'F' then cast(floor(o_totalprice) as bigint) else 0 end) as matched from orders join customer on c_custkey = o_custkey),
u as (select coalesce(sum(cast(floor(o_totalprice) as bigint)), 0) as outside from orders where o_custkey not in (select c_custkey from customer))
select cast(total - matched as bigint) as inexact_bytes, cast(coalesce((select sum(bytes) from parts where part in ('classified', 'missing')), 0) + outside as bigint) as reconciled_bytes,
  cast(total - matched - coalesce((select sum(bytes) from parts where part in ('classified', 'missing')), 0) - outside as bigint) as difference from t, u""",
)
def reconcile_balance(spark, d):
    """The totals of the orders as their customers report them, against what the inventory's parts account for."""
    o = T(spark, d, "orders")
    size = F.floor("o_totalprice").cast("long")
    report = o.join(T(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum(size).alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", size).otherwise(0)).alias("matched"))
    outside = o.join(T(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(size.alias("bytes"))
    return V.balance(reconcile_parts(spark, d), report, outside)


@query(
    "candidate_index",
    """with w as (select distinct o_custkey as s from orders where o_orderstatus = 'P')
select l_suppkey as s, count(*) as n, string_agg(distinct cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) as units, bool_or(l_returnflag = 'R') as unplaced, bool_or(l_quantity = 50) as stubbed from lineitem where l_suppkey in (select s from w) group by 1""",
)
def candidate_index(spark, d):
    wanted = T(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("s"))
    return V.candidates(T(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s"), wanted, "s", "l_linenumber", F.col("l_returnflag") == "R", F.col("l_quantity") == 50)


@query(
    "missing_placements",
    """with m as (select c_custkey as address, 'S' || c_custkey % 40 as symbol, c_nationkey from customer), p as (select s_suppkey as address, 'S' || s_suppkey % 30 as symbol from supplier),
c as (select 'S' || p_partkey % 35 as symbol, bool_or(p_size = 50) as unplaced, bool_or(p_size = 1 and p_partkey % 7 = 0) as stubbed from part group by 1)
select address, symbol, case when exists (select 1 from p where p.address = m.address and p.symbol <> m.symbol) then 'matched-under-another-name' when c.stubbed then 'stubbed' when c.unplaced then 'compiled-but-unplaced'
  when c.symbol is not null then 'placed-in-unit-residual-skips' when c_nationkey = 3 then 'unmapped-target-extent' else 'not-compiled' end as cause from m left join c using (symbol)""",
)
def missing_placements(spark, d):
    """Customers as missing functions: why each is missing, from suppliers placed at the same address and parts that define its symbol."""
    name = lambda c, n: F.concat(F.lit("S"), (F.col(c) % n).cast("string")).alias("symbol")
    missing = T(spark, d, "customer").select(F.col("c_custkey").alias("address"), name("c_custkey", 40), "c_nationkey")
    placed = V.placements(T(spark, d, "supplier").select(F.col("s_suppkey").alias("address"), name("s_suppkey", 30)), "address", "symbol")
    part = T(spark, d, "part").select("p_partkey", "p_size", name("p_partkey", 35))
    made = V.candidates(part, missing, "symbol", "p_partkey", F.col("p_size") == 50, (F.col("p_size") == 1) & (F.col("p_partkey") % 7 == 0))
    return V.missing_cause(missing, placed, made, "symbol", "address", F.col("c_nationkey") == 3).select("address", "symbol", "cause")


@query(
    "two_indexes",
    """select 'part' as by, l_partkey as key, cast(count(distinct l_suppkey) as int) as n_distinct, count(*) as n, min(l_suppkey) as first from lineitem group by 2
union all select 'supplier', l_suppkey, cast(count(distinct l_partkey) as int), count(*), min(l_partkey) from lineitem group by 2""",
)
def two_indexes(spark, d):
    by_part, by_supplier = V.two_indexes(T(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    row = lambda df, name, key, held: df.select(F.lit(name).alias("by"), F.col(key).alias("key"), F.size(held).alias("n_distinct"), "n", F.get(held, F.lit(0)).alias("first"))
    return row(by_part, "part", "l_partkey", "units").union(row(by_supplier, "supplier", "l_suppkey", "symbols"))


@query("keys_on_both", "select l_partkey, l_suppkey from lineitem where l_returnflag = 'A' intersect select l_partkey, l_suppkey from lineitem where l_returnflag = 'N'")
def keys_on_both(spark, d):
    x = T(spark, d, "lineitem")
    return V.on_both(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])


@query("absent_members", "select event_type || user_id as name, min(event_id) as event_id from events where event_type || user_id not in (select event_type || user_id from events where event_type in ('view', 'click') and user_id % 2 = 0) group by 1")
def absent_members(spark, d):
    e = T(spark, d, "events").withColumn("name", F.concat("event_type", F.col("user_id").cast("string")))
    return V.absent(e, e.where("event_type in ('view', 'click') and user_id % 2 = 0"), "name", "event_id")


@query("renamed_scores", "select coalesce('N' || n_nationkey, cast(c_custkey as varchar)) as key, c_acctbal as score from customer left join nation on n_nationkey = c_custkey")
def renamed_scores(spark, d):
    """Scores re-keyed; unknown names pass through."""
    names = T(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("new"))
    return V.with_others(T(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score")), names, "key", "new")


@query(
    "manifest_faults",
    """with m as (select 'p' || page_id as path, case when page_id % 9 = 0 then 'other' else sha256(html) end as s from pages union all select 'gone' || nation.n_nationkey, 'x' from nation)
select m.path, case when p.page_id is null then 'missing' else 'changed' end as fault from m left join pages p on 'p' || p.page_id = m.path where p.page_id is null or sha256(p.html) <> m.s""",
)
def manifest_faults(spark, d):
    """A manifest of pages by hash against the pages: entries that are gone and ones that changed."""
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    files = V.digests(T(spark, d, "pages").withColumn("path", path), "path", "html")
    edited = T(spark, d, "pages").withColumn("path", path).select("path", F.when(F.col("page_id") % 9 == 0, "other").otherwise(F.sha2(F.col("html").cast("binary"), 256)).alias("sha256"))
    gone = T(spark, d, "nation").select(F.concat(F.lit("gone"), F.col("n_nationkey").cast("string")).alias("path"), F.lit("x").alias("sha256"))
    return V.manifest_faults(edited.union(gone), files)


@query("input_hashes", "select url as path, sha256(html) as sha256 from pages")
def input_hashes(spark, d):
    return V.digests(T(spark, d, "pages"), "url", "html")


# --- text ------------------------------------------------------------------------------------------


@query(
    "text_kernels",
    r"""with o as (select o_orderkey as k, o_custkey as c from orders)
select k, case when k % 2 = 0 then 'a' || k % 7 || '.cpp' else '/q/a' || k % 7 || '.cpp' end as path, cast(case when k % 3 = 0 then k % 100 else 0 end as int) as line, cast(case when k % 5 = 0 then 0 else least(abs(k % 100 - c % 50), abs(k % 100 - c % 70)) end as int) as distance,
  (k % 1000) / 10.0::double as short, repeat('int x;', k % 3) || 'src' || c % 4 as padded, (['b', 'c', 'a', null])[k % 4 + 1] as next, case when k % 13 = 0 then 'eax' when k % 13 = 4 then 'ecx' end as register,
  (['_Z1' || k, '.rodata.str1.1', '.rodata.str4.4', '.data'])[k % 4 + 1] as identity, (([null, 'utf8', 'utf32le', null])[k % 4 + 1]) as encoding, k + c + case when k % 2 = 0 then 6 else 0 end as place, case when k % 5 = 0 then 'x_y' when k % 5 = 1 then 'x_' || c else 'x' end as variable,
  (k % 4 < 2 and (['<', '>', '<=', '>='])[c % 4 + 1] = '<') or (k % 4 = 2 and (['<', '>', '<=', '>='])[c % 4 + 1] = '>') as mirrored from o""",
)
def text_kernels(spark, d):
    """Scalar functions over text that orders' keys give, in all of their cases."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda m: (k % m).cast("string")
    pick = lambda values, of: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (of % len(values) + 1).cast("int"))
    line = pick([F.concat(F.lit("line "), n(100), F.lit(": moved")), "see line 5", "moved"], k)
    section = pick([F.concat(F.lit(".text._Z1"), k.cast("string")), ".rodata.str1.1", ".rodata.str4.4", ".data"], k)
    root = F.when(k % 2 == 0, "/r//./a").otherwise("/q/./a")
    variable = pick(["x_y", F.concat(F.lit("x_"), c.cast("string"), F.lit("_3")), F.concat(F.lit("x_"), n(9)), F.concat(F.lit("x_"), n(9), F.lit("(D)")), "x"], k)
    versioned = F.array(F.concat(F.lit("x_"), n(9)), F.lit("y_2(D)"))
    sides = pick([F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("x")), F.array(F.lit("y"), F.lit("z"))], k)
    lines = F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((c % 50).cast("int"), (c % 70).cast("int")))
    return T(spark, d, "orders").select(
        k.alias("k"),
        X.relative(F.concat(root, n(7), F.lit(".cpp")), "/r").alias("path"),
        X.line_of(line).alias("line"),
        X.distance((k % 100).cast("int"), lines).alias("distance"),
        X.shortest((k % 1000) / 10).alias("short"),
        X.padded(F.concat(F.lit("src"), (c % 4).cast("string")), "int x;", k % 3).alias("padded"),
        X.next_in_ring(pick(["a", "b", "c", "z"], k), list("abc")).alias("next"),
        X.table_entry(k % 13, 4, ["eax", "ecx"]).alias("register"),
        X.section_identity(section).alias("identity"),
        X.string_encoding(section).alias("encoding"),
        X.reference_place(k, c, k % 2 == 0, F.lit(2)).alias("place"),
        X.without_version(variable).alias("variable"),
        X.same_comparison(versioned, F.lit("<"), sides, pick(["<", ">", "<=", ">="], c)).alias("mirrored"),
    )


@query(
    "replacement_tables",
    """select o_custkey, cast(o_orderkey as int) as version, 'v' || o_orderkey % 5 as value, 'p' || o_orderkey % 3 as name from orders""",
)
def replacement_tables(spark, d):
    """Orders written as two tables of a dump's text per customer, parsed and joined by version."""
    k = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit("t_"), k, F.lit(" replace with --> t = v"), (F.col("o_orderkey") % 5).cast("string"), F.lit(";"))
    two = F.concat(F.lit("Partition 1 (p"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" - "), k, F.lit(" )"))
    text = T(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(one, F.lit("\n"), two)), "\n").alias("text"))
    values = text.select("o_custkey", F.inline(X.replacements(F.col("text"))))
    return values.join(text.select("o_custkey", F.inline(X.partition_names(F.col("text")))), ["o_custkey", "version"])


_REGISTERS = "(['eax', 'ebx', 'ecx', 'si', 'r8'])[{i} + 1]"


@query("arrow_pairs", f"""select user_id, {_REGISTERS.format(i="k % 4")} as source, {_REGISTERS.format(i="(k + 1) % 4")} as target from (select user_id, min(event_id) as k from events group by 1)""")
def arrow_pairs(spark, d):
    """Pairs of registers ``target->source`` in text, as a map and rows again; what names no register is left out."""
    k = T(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("k"))
    name = lambda i: F.element_at(F.array(*map(F.lit, ["eax", "ebx", "ecx", "si"])), (i % 4 + 1).cast("int"))
    text = F.concat(F.lit("moves ax1->x, dx->"), name(F.col("k")), F.lit(", "), name(F.col("k") + 1), F.lit("->"), name(F.col("k")), F.lit(", r8->eax9; done"))
    return k.select("user_id", F.explode(X.arrows(text)).alias("source", "target"))


@query(
    "registers_by_offset",
    f"""with f as (select o_custkey, o_orderkey as k, {_REGISTERS.format(i="o_orderkey % 4")} as a, {_REGISTERS.format(i="o_orderkey % 3")} as b, case when o_orderkey % 2 = 0 then [o_orderkey % 7, o_orderkey % 5 + 7] else [o_orderkey % 11] end as offs from orders where o_orderkey % 3 <> 2),
e as (select o_custkey, k, a as theirs, b as ours, unnest(offs) as "offset" from f union all select o_custkey, k, 'edx', 'edi', unnest(offs) from f)
select o_custkey, "offset", ours, arg_max(theirs, k) as theirs from e group by 1, 2, 3""",
)
def registers_by_offset(spark, d):
    """Orders as findings of their customer: which register stands for which at each place, by the last finding that says so."""
    k = F.col("o_orderkey")
    name = lambda n: F.element_at(F.array(*map(F.lit, ["eax", "ebx", "ecx", "si"])), (k % n + 1).cast("int"))
    found = T(spark, d, "orders").select(
        "o_custkey",
        k.alias("n"),
        F.when(k % 3 == 2, "padding").otherwise("register-allocation").alias("cause"),
        F.concat(name(4), F.lit("->"), name(3), F.lit(", edx->edi, r12->r13")).alias("detail"),
        F.when(k % 2 == 0, F.array(k % 7, k % 5 + 7)).otherwise(F.array().cast("array<bigint>")).alias("offsets"),
        (k % 11).alias("candidate"),
    )
    return D.registers_by_offset(found, ["o_custkey"], "n")


@query(
    "rendered_pages",
    """with f as (select o_custkey as unit, 1 as rank, o_orderkey as n, printf('differs 0x%x: %s', o_orderkey, o_orderstatus) as line from orders where o_orderstatus <> 'P'
union all select o_custkey, 2, o_orderkey, printf('open %d of %s', o_orderkey, o_orderpriority) from orders where o_orderstatus = 'P')
select unit, count(*) as n_lines, string_agg(line, chr(10) order by rank, n) as text from f group by 1""",
)
def rendered_pages(spark, d):
    """Each customer's orders as a text report of two kinds of findings."""
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("n"), "o_orderstatus", "o_orderpriority")
    differs = render.lines(o.where("o_orderstatus <> 'P'").withColumn("rank", F.lit(1)), ["unit", "rank", "n"], "differs", "differs %s: %s", render.hexadecimal(F.col("n")), "o_orderstatus")
    rest = render.lines(o.where("o_orderstatus = 'P'").withColumn("rank", F.lit(2)), ["unit", "rank", "n"], "open", "open %d of %s", "n", "o_orderpriority")
    return render.page([differs, rest], ["unit"], ["rank", "n"])
