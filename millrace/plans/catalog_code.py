"""Registered queries of the instruction operators; order lines stand in for instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import instructions as I
from millrace.plans import bindings as B
from millrace.plans.alignment_sql import BLOCKS
from millrace.plans.catalog import query


def instructions(spark, d):
    """Per customer the filled and the open orders as two instruction arrays (ours, theirs)."""
    o = B.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    null = F.lit(None)
    names = F.array(*map(F.lit, ["mov", "add", "cmp", "jl", "jge", "call", "nop"]))
    registers = F.array(*map(F.lit, ["rax", "rbx", "rsp", "xmm0"]))
    mnemonic = F.element_at(names, (F.substring("o_orderpriority", 1, 1).cast("int") + F.col("o_orderkey").cast("int") % 3))
    operand = lambda kind, names, rest, place: F.struct(kind.alias("kind"), names.alias("names"), rest.cast("string").alias("rest"), place.cast("bigint").alias("place"))
    first = operand(F.lit("reg"), F.array(F.element_at(registers, (k % 4 + 1).cast("int"))), null, null)
    memory = k % 2 == 0
    base = F.when(memory, F.array(F.element_at(registers, (k % 3 + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    second = operand(F.when(memory, "mem").otherwise("imm"), base, F.when(memory, "1x4").otherwise((k % 3).cast("string")), F.when(memory, k % 5))
    row = F.struct(k.alias("at"), mnemonic.alias("mnemonic"), F.array(first, second).alias("operands"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == s, row)))
    return o.groupBy(c).agg(side("F").alias("ours"), side("O").alias("theirs"))


_CLASS = "case when {r} = 'rsp' then 'rsp' when {r} = 'xmm0' then 'xmm' else 'gpr' end"
_VIEWS = f"""o as (select o_custkey, o_orderkey as k, o_orderstatus as s, o_totalprice, (['mov', 'add', 'cmp', 'jl', 'jge', 'call', 'nop'])[cast(left(o_orderpriority, 1) as int) + o_orderkey % 3] as m, (['rax', 'rbx', 'rsp', 'xmm0'])[o_orderkey % 4 + 1] as reg, (['rax', 'rbx', 'rsp'])[o_orderkey % 3 + 1] as base from orders),
v as (select *, m || ' reg:' || reg || ' ' || case when k % 2 = 0 then 'mem:' || base || ',1x4,' || k % 5 else 'imm:' || k % 3 end as exact,
  m || ' reg:' || {_CLASS.format(r="reg")} || ' ' || case when k % 2 = 0 then 'mem:' || {_CLASS.format(r="base")} || ',1x4,' || k % 5 else 'imm:' || k % 3 end as registers,
  m || ' reg:' || {_CLASS.format(r="reg")} || ' ' || case when k % 2 = 0 then case when base = 'rsp' then 'frame' else 'mem:' || {_CLASS.format(r="base")} || ',1x4,' || k % 5 end else 'imm:' || k % 3 end as frame, m as opcodes from o)"""


_SIDES = f"""{_VIEWS},
c as (select distinct o_custkey from o),
side as (select o_custkey as key, s, list({{'k': k, 'm': m, 'reg': reg, 'base': base, 'exact': exact, 'view': registers}} order by k) as l from v where s in ('F', 'O') and KEEP group by 1, 2),
pairs as (select c.o_custkey as key, coalesce(a.l, []) as la, coalesce(b.l, []) as lb from c left join (select * from side where s = 'F') a on a.key = c.o_custkey left join (select * from side where s = 'O') b on b.key = c.o_custkey)"""


@query(
    "code_differences",
    f"""with recursive {_SIDES.replace("KEEP", "m <> 'nop'")}, seqs as (select key, list_transform(la, lambda x: x.view) as a, list_transform(lb, lambda x: x.view) as b from pairs), {BLOCKS},
places as (select key, true as same, unnest(range(i, i + n)) as p, unnest(range(j, j + n)) as q from blocks union all select key, false, unnest(range(i1, i2)), unnest(range(j1, j2)) from gaps where i2 - i1 = j2 - j1),
at as (select key, same, la[p + 1] as x, lb[q + 1] as y from places join pairs using (key)),
place as (select key, 1 as rows, case when same then 'register-allocation' when (x.m = 'jl' and y.m = 'jge') or (x.m = 'jge' and y.m = 'jl') then 'block-order' when x.m <> y.m then 'instruction-selection'
  when x.k % 2 = 0 and y.k % 2 = 0 and x.base = y.base and x.k % 5 <> y.k % 5 then case when x.base = 'rsp' then 'stack-layout' else 'struct-layout' end when x.k % 2 = 1 and y.k % 2 = 1 and x.k % 3 <> y.k % 3 then 'immediate-or-reloc' else 'instruction-selection' end as cause from at where x.exact <> y.exact),
two as (select key, la[i1 + 1:i2] as x, lb[j1 + 1:j2] as y from gaps join pairs using (key) where i2 - i1 <> j2 - j1),
loose as (select key, x as run, y as other from two where len(x) > 0 union all select key, y, x from two where len(y) > 0),
facts as (select key, len(run) as rows, len(list_filter(run, lambda z: z.m = 'call')) > 0 as calls, len(list_filter(other, lambda z: z.m = 'call')) > 0 as others, len(list_filter(run, lambda z: z.m <> 'mov' and not (z.m = 'add' and z.reg = 'rsp'))) = 0 as moves from loose),
run as (select key, rows, case when calls and not others then 'inlining' when others and not calls and rows >= 3 then 'inlining' when moves then 'register-allocation' when rows < 3 then 'instruction-selection' else 'unknown' end as cause from facts)
select key as o_custkey, cause, count(*) as n, cast(sum(rows) as bigint) as n_rows from (select key, cause, rows from place union all select key, cause, rows from run) group by 1, 2""".replace("at as (", "met as (").replace("from at where", "from met where"),
)
def code_differences(spark, d):
    """Causes and rows of the differences of every customer's two arrays."""
    return I.differences(instructions(spark, d), "o_custkey").groupBy("o_custkey", "cause").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("n_rows"))


_LEVELS = f"""{_SIDES.replace("KEEP", "true")},
t as (select o_custkey, s, string_agg(exact, '; ' order by k) as exact, string_agg(registers, '; ' order by k) as registers, string_agg(frame, '; ' order by k) as frame, string_agg(opcodes, '; ' order by k) as opcodes from v group by all),
lv as (select c.o_custkey as key, case when a.exact is not distinct from b.exact then 'exact' when a.registers is not distinct from b.registers then 'registers' when a.frame is not distinct from b.frame then 'frame' when a.opcodes is not distinct from b.opcodes then 'opcodes' else 'sequence' end as level
  from c left join (select * from t where s = 'F') a using (o_custkey) left join (select * from t where s = 'O') b using (o_custkey)),
seqs as (select key, list_transform(la, lambda x: x.m) as a, list_transform(lb, lambda x: x.m) as b from pairs join lv using (key) where level = 'sequence'), {BLOCKS},
st as (select key, count(*) filter (where i2 > i1 or j2 > j1) as stretches, sum(greatest(i2 - i1, j2 - j1)) as instructions, min(case when i2 > i1 or j2 > j1 then {{'i1': i1, 'i2': i2, 'j1': j1, 'j2': j2}} end) as r from gaps group by 1),
nm as (select key, flatten(list_transform(la, lambda x: if(x.k % 2 = 0, [x.reg, x.base], [x.reg]))) as x, flatten(list_transform(lb, lambda x: if(x.k % 2 = 0, [x.reg, x.base], [x.reg]))) as y from pairs join lv using (key) where level = 'registers'),
rn as (select key, len(list_distinct(list_zip(x, y))) as n, len(list_distinct(x)) as nx, len(list_distinct(y)) as ny from nm)"""


@query(
    "code_agreement",
    f"""with recursive {_LEVELS} select level, count(*) as n, count(*) filter (where rn.n = nx and rn.n = ny) as n_renamed, cast(coalesce(sum(stretches), 0) as bigint) as n_stretches, cast(coalesce(sum(instructions), 0) as bigint) as n_instructions from lv left join st using (key) left join rn using (key) group by 1""",
)
def code_agreement(spark, d):
    """The strictest level at which each customer's two arrays agree, with consistent renamings and differing stretches."""
    c = I.classified(instructions(spark, d), "o_custkey")
    total = lambda name: F.sum(F.coalesce(name, F.lit(0)))
    return c.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count("renaming").alias("n_renamed"), total("stretches").alias("n_stretches"), total("instructions").alias("n_instructions"))


_I = """i as (select o_custkey, o_orderkey as k, (['mov', 'add', 'cmp', 'jl', 'jge', 'call', 'nop'])[cast(left(o_orderpriority, 1) as int) + o_orderkey % 3] as m, (['rax', 'rbx', 'rsp', 'xmm0'])[o_orderkey % 4 + 1] as reg from orders)"""


@query(
    "code_predicates",
    f"""with {_I} select k, m = 'nop' as padding, m = 'mov' or (m = 'add' and reg = 'rsp') as moves, m || ' reg:' || case when reg = 'rsp' then 'rsp' when reg = 'xmm0' then 'xmm' else 'gpr' end as shape from i join orders on o_orderkey = k where o_orderstatus in ('F', 'O')""",
)
def code_predicates(spark, d):
    one = instructions(spark, d).select(F.explode(F.concat("ours", "theirs")).alias("i"))
    first = F.struct(F.col("i.at").alias("at"), F.col("i.mnemonic").alias("mnemonic"), F.slice("i.operands", 1, 1).alias("operands"))
    i = F.col("i")
    return one.select(F.col("i.at").alias("k"), I.is_padding(i).alias("padding"), I.moves_data(i).alias("moves"), I.view(first, "registers").alias("shape"))


@query("code_views", f"with {_VIEWS} select k, exact, registers, frame, opcodes, case when m not in ('cmp', 'call') then reg end as written from v where s in ('F', 'O')")
def code_views(spark, d):
    """Every instruction at each level of looseness, and the register that it writes."""
    i = F.col("i")
    one = instructions(spark, d).select(F.explode(F.concat("ours", "theirs")).alias("i"))
    return one.select(F.col("i.at").alias("k"), *[I.view(i, n).alias(n) for n in I.VIEWS], I.written(i).alias("written"))


@query(
    "pair_causes",
    f"""with {_VIEWS}, p as (select k, m, base, lead(k) over w as k2, lead(m) over w as m2, lead(base) over w as base2 from v where s in ('F', 'O') window w as (partition by o_custkey, s order by k))
select k, case when (m = 'jl' and m2 = 'jge') or (m = 'jge' and m2 = 'jl') then 'block-order' when m <> m2 then 'instruction-selection' when k % 2 = 0 and k2 % 2 = 0 and base = base2 and k % 5 <> k2 % 5 then case when base = 'rsp' then 'stack-layout' else 'struct-layout' end
  when k % 2 = 1 and k2 % 2 = 1 and k % 3 <> k2 % 3 then 'immediate-or-reloc' else 'instruction-selection' end as cause from p where k2 is not null""",
)
def pair_causes(spark, d):
    """Each instruction against the next one of its array: the cause that their facts mean."""
    sides = instructions(spark, d).select(F.explode(F.array("ours", "theirs")).alias("run")).where(F.size("run") > 1)
    follows = F.arrays_zip(F.slice("run", 1, F.size("run") - 1).alias("a"), F.slice("run", 2, F.size("run") - 1).alias("b"))
    pairs = sides.select(F.inline(follows))
    return pairs.select(F.col("a.at").alias("k"), I.pair_cause(F.col("a"), F.col("b")).alias("cause"))


@query(
    "level_census",
    f"""with {_VIEWS}, t as (select o_custkey, s, string_agg(exact, '; ' order by k) as exact, string_agg(registers, '; ' order by k) as registers, string_agg(frame, '; ' order by k) as frame, string_agg(opcodes, '; ' order by k) as opcodes from v group by all),
c as (select o_custkey, sum(cast(o_totalprice as decimal(20,2))) as bytes from v group by 1),
l as (select c.o_custkey, bytes, case when a.exact is not distinct from b.exact then 'exact' when a.registers is not distinct from b.registers then 'registers' when a.frame is not distinct from b.frame then 'frame' when a.opcodes is not distinct from b.opcodes then 'opcodes' else 'sequence' end as level
  from c left join (select * from t where s = 'F') a using (o_custkey) left join (select * from t where s = 'O') b using (o_custkey))
select level, count(*) as n, cast(sum(bytes) as double) as bytes from l group by 1""",
)
def level_census(spark, d):
    """Customers and their order value per level at which their two arrays agree."""
    sizes = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("bytes"))
    levels, _ = I.level_census(I.classified(instructions(spark, d), "o_custkey").join(sizes, "o_custkey"), "o_custkey", F.col("bytes"))
    return levels.select("level", "n", F.col("bytes").cast("double").alias("bytes"))


_PART = "case when r.{i}1 = r.{i}2 then '-' else array_to_string({c}[r.{i}1 + 1:r.{i}2], ' ') end"


@query(
    "shared_signatures",
    f"""with recursive {_LEVELS}, sg as (select key, {_PART.format(i="i", c="a")} || ' / ' || {_PART.format(i="j", c="b")} as signature from st join seqs using (key) where stretches = 1)
select signature, count(*) as n, min(key) as first, max(key) as last from sg group by 1 having count(*) > 1""",
)
def shared_signatures(spark, d):
    """Differing stretches that several customers share, where a customer has one."""
    return I.level_census(I.classified(instructions(spark, d), "o_custkey"), "o_custkey", F.lit(0))[1]
