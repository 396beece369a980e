"""Registered queries of searches, samples, memos, renamings, sweeps and streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from millrace.operators import graphs as G
from millrace.operators import samples as P
from millrace.operators import search as S
from millrace.operators import sweeps as W
from millrace.operators import trials as C
from millrace.plans import bindings as B
from millrace.plans.catalog import query
from millrace.sources.scratch import folder
from millrace.streaming import census as K

T = B.table


def recorded_moves(spark, d):
    """Orders as sources of their customer: a rewrite leads to each of the three orders before and after; a score by price, failed ones are pending."""
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("target"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("price"), (F.col("o_orderstatus") != "P").alias("valid"))
    w = Window.partitionBy("unit").orderBy("target")
    near = F.array(*[F.struct(F.lit((k % 3) * 2 + (k > 3)).alias("place"), (F.lag if k < 4 else F.lead)("target", k % 3 + 1).over(w).alias("target")) for k in range(1, 7)])
    moves = o.withColumn("near", near).select("unit", F.col("target").alias("source"), F.explode("near").alias("m")).select("unit", "source", "m.place", "m.target").where("target is not null")
    scores = o.select("unit", "target", (F.col("price") % 20).alias("score"), "valid")
    first = o.groupBy("unit").agg(F.min_by(F.struct(F.col("target").alias("at"), (F.col("price") % 20).alias("score")), "target").alias("s"))
    return first.select("unit", "s.at", "s.score"), moves, scores


_O = "o as (select o_custkey as unit, o_orderkey as target, cast(floor(o_totalprice / 1000) as bigint) % 20 as score, o_orderstatus <> 'P' as valid from orders)"


def _search_sql(budget: int, batch: int, perfect: int, better: str) -> str:
    """The search as recursive SQL: a row a unit and round, with what was tried as a list."""
    return f"""with recursive {_O},
m as (select unit, target as source, unnest([lag(target, 2) over w, lag(target, 3) over w, lag(target, 1) over w, lead(target, 2) over w, lead(target, 3) over w, lead(target, 1) over w]) as target, unnest([2, 4, 0, 3, 5, 1]) as place from o window w as (partition by unit order by target)),
ml as (select unit, source, list(target order by place, target) as ts from m where target is not null group by 1, 2),
sm as (select unit, map(list(target), list(case when valid then score else -1 end)) as sc from o group by 1),
r as (
  select unit, min(target) as here, arg_min(score, target) as score, arg_min(score, target) as best, min(target) as best_at, 0 as tried, 0 as n_moves, [min(target)] as seen, case when arg_min(score, target) >= {perfect} then 'exact' end as reason, min(target) as source, false as moved from o group by 1
  union all
  select unit, if(mx {better} score, go, here), if(mx {better} score, mx, score), greatest(best, coalesce(mx, best)), if(mx > best, go, best_at), tried + len(tries), n_moves + coalesce((mx {better} score)::int, 0), list_concat(seen, tries),
    case when greatest(best, coalesce(mx, best)) >= {perfect} then 'exact' when tried + len(tries) >= {budget} then 'budget spent' when len(tries) = 0 then 'nothing left' end, here, coalesce(mx {better} score, false)
  from (select *, tries[list_position(f, mx)] as go from (select *, list_max(f) as mx from (select *, list_transform(tries, lambda t: sc[t]) as f from (
    select r.*, sc, list_filter(coalesce(ts, []), lambda t: not list_contains(seen, t))[1:least({batch}, {budget} - tried)] as tries from r join sm using (unit) left join ml on ml.unit = r.unit and ml.source = r.here where reason is null
  ))))
)"""


@query("batch_search", _search_sql(7, 3, 19, ">") + ' select unit, here as "at", score, best, best_at, cast(tried as int) as tried, n_moves, reason from r where reason is not null')
def batch_search(spark, d):
    """Each customer's search for the best order in batches of three, seven tries at most."""
    return S.batch_search(*recorded_moves(spark, d), budget=7, batch=3, perfect=19)[0]


@query("batch_search_steps", _search_sql(9, 2, 18, ">=") + " select unit, n_moves as step, source, here as target, score from r where moved")
def batch_search_steps(spark, d):
    """The moves of a search that also goes to sources as good as its own."""
    return S.batch_search(*recorded_moves(spark, d), budget=9, batch=2, perfect=18, ties=True)[1]


@query(
    "block_climb",
    """with recursive b as (select l_orderkey as unit, l_partkey as block, max(l_quantity) as q, min(l_suppkey) as s from lineitem group by 1, 2),
c as (select unit, list({'a': if(q <= next_q, block, next), 'b': if(q <= next_q, next, block)}) as cons from (select *, lead(block) over w as next, lead(q) over w as next_q from b window w as (partition by unit order by block)) where next is not null and q <> next_q group by 1),
p as (select unit, list(block order by s, block) as p, coalesce(any_value(cons), []) as cons from b left join c using (unit) group by 1),
r as (
  select unit, p, cons, list_transform(cons, lambda c: list_position(p, c.a) < list_position(p, c.b)) as held, [p] as seen, 0 as tried, 0 as step, 0 as i, 0 as j, 0 as block, true as live, false as moved from p
  union all
  select unit, if(ok, go.q, p), cons, if(ok, go.held, held), list_concat(seen, list_transform(tries, lambda t: t.q)), tried + len(tries), step + ok::int, if(ok, go.i, 0), if(ok, go.j, 0), if(ok, p[go.i + 1], 0), len(tries) > 0 and tried + len(tries) < 24, ok
  from (select *, go is not null as ok from (select *, list_filter(good, lambda g: g.n = list_max(list_transform(good, lambda h: h.n)))[1] as go from (
    select *, list_filter(list_transform(tries, lambda t: {'i': t.i, 'j': t.j, 'q': t.q, 'held': list_transform(cons, lambda c: list_position(t.q, c.a) < list_position(t.q, c.b)), 'n': len(list_filter(cons, lambda c: list_position(t.q, c.a) < list_position(t.q, c.b)))}),
      lambda g: g.n > len(list_filter(held, lambda h: h)) and len(list_filter(list_zip(held, g.held), lambda z: z[1] and not z[2])) = 0) as good
    from (
      select *, list_filter(fresh, lambda t, k: list_position(list_transform(fresh, lambda y: y.q), t.q) = k)[1:least(8, 24 - tried)] as tries from (
        select *, list_filter(list_sort(flatten(list_transform(range(len(p)), lambda i: list_transform(list_filter(range(len(p)), lambda j: j <> i), lambda j: {'o': (i * 7 + j * 3) % 11, 'i': i, 'j': j,
          'q': list_concat(list_concat(list_concat(p[1:i], p[i + 2:])[1:j], [p[i + 1]]), list_concat(p[1:i], p[i + 2:])[j + 1:])})))), lambda t: not list_contains(seen, t.q)) as fresh
        from r where live
      ))
  )))
)
select unit, step, cast(i as int) as i, cast(j as int) as j, block, cast(len(list_filter(held, lambda h: h)) as bigint) as total from r where moved""",
)
def block_climb(spark, d):
    """Moves of one part at a time that put more neighbours of each order in the order of their quantities, and none out of it."""
    lines = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("block"), "l_quantity", "l_suppkey").repartition("unit")  # once: all that follows is by unit
    lines = lines.groupBy("unit", "block").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("supplier"))
    w = Window.partitionBy("unit").orderBy("block")
    pairs = lines.select("unit", "block", "l_quantity", F.lead("block").over(w).alias("next"), F.lead("l_quantity").over(w).alias("other")).where("next is not null and l_quantity <> other")
    first = F.col("l_quantity") <= F.col("other")
    constraints = pairs.select("unit", F.col("block").alias("dependent"), F.when(first, F.col("block")).otherwise(F.col("next")).alias("before"), F.when(first, F.col("next")).otherwise(F.col("block")).alias("after"))
    blocks = lines.select("unit", "block", (F.row_number().over(Window.partitionBy("unit").orderBy("supplier", "block")) - 1).alias("place"))
    return S.climb_precedence(blocks, constraints, budget=24, per_round=8, order=lambda i, j: (i * 7 + j * 3) % 11)


_CLEAN = """with recursive e as (select distinct o_custkey as unit, l_suppkey % 12 as addition, l_partkey % 40 as fault from lineitem join orders on o_orderkey = l_orderkey),
f as (select unit, fault from e union select unit, -1 from e where unit % 9 = 0),
a as (select unit, list({'x': addition, 'fs': fs} order by addition) as adds from (select unit, addition, list(fault) as fs from e group by 1, 2) group by 1),
r as (
  select f.unit, list(fault) as open, any_value(adds) as adds, 0 as step, cast(null as bigint) as addition, 0 as repaired from f left join a on a.unit = f.unit group by 1
  union all
  select unit, list_filter(open, lambda x: not list_contains(adds[k].fs, x)), adds, step + 1, adds[k].x, mx from (select *, list_position(ns, mx) as k from (select *, list_max(ns) as mx from (
    select *, list_transform(adds, lambda y: len(list_intersect(y.fs, open))) as ns from r))) where mx > 0
)"""


def _broken(spark, d):
    lines = T(spark, d, "lineitem").join(T(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = lines.select(F.col("o_custkey").alias("unit"), (F.col("l_suppkey") % 12).alias("addition"), (F.col("l_partkey") % 40).alias("fault")).distinct()
    return edges, edges.select("unit", "fault").union(edges.where("unit % 9 = 0").select("unit", F.lit(-1).cast("long")))


@query("until_clean", _CLEAN + " select unit, step, addition, cast(repaired as bigint) as repaired, cast(len(open) as bigint) as left from r where step > 0")
def until_clean(spark, d):
    """The additions that repair most of what is broken of each customer, one after the other."""
    return S.until_clean(*_broken(spark, d))[0]


@query("clean_units", _CLEAN + " select unit, cast(min(len(open)) as bigint) as left, case when min(len(open)) = 0 then 'clean' else 'stuck' end as reason from r group by 1")
def clean_units(spark, d):
    return S.until_clean(*_broken(spark, d))[1]


# --- samples -----------------------------------------------------------------------------------


def _mutations(spark, d):
    """Lines as mutations of a supplier's functions, with their recorded effect."""
    kind = F.element_at(F.array(*map(F.lit, ["swap", "move", "name", "inline"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_partkey") % 10).alias("symbol"), kind.alias("mutation"), "l_discount", "l_returnflag", "l_linestatus", "l_quantity")
    one = rows.groupBy("unit", "symbol", "mutation").agg(F.min("l_discount").alias("discount"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.min("l_quantity").cast("long").alias("q"))
    effect = P.effect(F.col("discount") > 0.08, F.col("flag") != "A", F.col("q") % 3, F.col("status") == "O")
    return one.select("unit", "symbol", "mutation", effect.alias("effect"))


_MUTATIONS = """m as (select l_suppkey as unit, l_partkey % 10 as symbol, (['swap', 'move', 'name', 'inline'])[l_linenumber % 4 + 1] as mutation, min(l_discount) as discount, max(l_returnflag) as flag, max(l_linestatus) as status, cast(min(l_quantity) as bigint) as q from lineitem group by 1, 2, 3),
e as (select unit, symbol, mutation, case when flag = 'A' then null when discount > 0.08 then 'does not compile' when q % 3 = 0 then 'no effect' when q % 3 = 1 and status = 'O' then 'case' else 'beyond the function' end as effect from m)"""


@query("case_tally", f"""with {_MUTATIONS}, k as (select unnest(['does not compile', 'no effect', 'beyond the function', 'case']) as effect) select mutation, k.effect, count(*) filter (where e.effect = k.effect) as n from e, k group by 1, 2""")
def case_tally(spark, d):
    """How many mutations of each kind had each effect."""
    return P.tally(_mutations(spark, d))


_CASES = """select unit, symbol, mutation, draw from (select *, row_number() over (partition by mutation order by draw, unit, symbol) as k from (select unit, symbol, mutation, substr(md5('{seed}:' || unit || '/' || symbol || '/' || mutation), 1, 16) as draw from e where {which})) where k <= {k}"""


@query("sampled_cases", f"with {_MUTATIONS} " + _CASES.format(seed=7, k=6, which="effect = 'case'"))
def sampled_cases(spark, d):
    """Six cases of each kind of mutation at random: a sampling operator."""
    return P.cases(_mutations(spark, d), seed=7, per_kind=6)


@query(
    "two_step_cases",
    f"""with {_MUTATIONS}, a as ({_CASES.format(seed=1, k=200, which="effect = 'case'")}), b as ({_CASES.format(seed=2, k=300, which="effect <> 'does not compile'")}),
p as (select a.unit, a.symbol, a.mutation, b.mutation as "then", substr(md5('3:' || a.unit || '/' || a.symbol || '/' || a.mutation || '/' || b.mutation), 1, 16) as draw from a join b on a.unit = b.unit and a.symbol = b.symbol and a.mutation <> b.mutation),
o as (select * from (select *, row_number() over (partition by unit, symbol order by draw, mutation, "then") as k from p) where k = 1)
select unit, symbol, mutation, "then", draw from o order by draw, unit, symbol limit 40""",
)
def two_step_cases(spark, d):
    """Forty compositions of a sampled case with a second sampled step of another kind: a sampling operator."""
    rows = _mutations(spark, d)
    first = P.cases(rows, seed=1, per_kind=200)
    steps = rows.where("effect <> 'does not compile'").select("unit", "symbol", "mutation", P.drawn(F.concat_ws("/", "unit", "symbol", "mutation"), 2).alias("draw"))
    return P.pairs(first, P.sketch(steps, ["mutation"], 300, ["draw", "unit", "symbol"]), seed=3, count=40)


# --- trials with a memo ---------------------------------------------------------------------------


def header_trials(spark, d):
    """Nations as headers with three candidate texts and the text as it is; suppliers as the units that include them."""
    nation = T(spark, d, "nation").select(F.col("n_nationkey").alias("header"), F.col("n_name").alias("name"))
    number = F.explode(F.array(F.lit(None).cast("int"), F.lit(1), F.lit(2), F.lit(3)))
    candidates = nation.select("header", "name", number.alias("candidate")).select("header", "candidate", F.concat("name", F.coalesce(F.concat(F.lit("+"), F.col("candidate").cast("string")), F.lit(""))).alias("content"))
    return candidates, T(spark, d, "supplier").select(F.col("s_nationkey").alias("header"), F.col("s_suppkey").alias("unit"), F.col("s_name").alias("content"))


def measure_texts(rows):
    """What stands for a measurement here: three functions scored by a hash of both texts; some texts that end in +2 fail."""
    both = F.concat("candidate_content", F.lit("|"), "unit_content")
    digit = lambda c: F.ascii(F.substring(F.md5(c.cast("binary")), 1, 1))
    fails = F.col("candidate_content").endswith("+2") & (digit(both) % 3 == 0)
    each = rows.where(~fails).withColumn("symbol", F.explode(F.array(*map(F.lit, "fgh")))).withColumn("score", (digit(F.concat(both, F.col("symbol"))) % 5 * 25).cast("double"))
    return each.select("digest", "symbol", "score", (F.col("score") == 100).alias("exact"))


@query(
    "counterfactual",
    """with c as (select n_nationkey as header, k as candidate, n_name || coalesce('+' || k, '') as content from nation, (values (null), (1), (2), (3)) as v(k)),
t as (select c.header, candidate, s_suppkey as unit, c.content || '|' || s_name as x, c.content as content from c join supplier on s_nationkey = header),
f as (select *, right(content, 2) = '+2' and ascii(md5(x)) % 3 = 0 as failed from t),
e as (select header, candidate, unit, symbol, ascii(md5(x || symbol)) % 5 * 25 as score from f, (values ('f'), ('g'), ('h')) as s(symbol) where not failed),
d as (select a.header, a.candidate, count(*) filter (where b.score = 100 and a.score <> 100) as n_lost, count(*) filter (where a.score = 100 and b.score <> 100) as n_gained, count(*) filter (where a.score <> b.score) as n_changed, count(*) filter (where a.score < b.score) as n_worse
  from e a join e b on b.candidate is null and a.header = b.header and a.unit = b.unit and a.symbol = b.symbol where a.candidate is not null group by 1, 2)
select f.header, cast(f.candidate as int) as candidate, count(*) as n_units, coalesce(any_value(n_lost), 0) as n_lost, coalesce(any_value(n_gained), 0) as n_gained, coalesce(any_value(n_changed), 0) as n_changed, coalesce(any_value(n_worse), 0) as n_worse, count(*) filter (where failed) as n_failed
from f left join d on d.header = f.header and d.candidate = f.candidate where f.candidate is not null group by 1, 2""",
)
def counterfactual(spark, d):
    """What each candidate does to its nation's suppliers; the first candidate was measured in an earlier run, whose memo answers for it."""
    candidates, dependents = header_trials(spark, d)
    none = spark.createDataFrame([], C.MEMO)
    _, memo = C.counterfactual(candidates.where("coalesce(candidate, 1) = 1"), dependents, none, measure_texts)
    return C.counterfactual(candidates, dependents, memo, measure_texts)[0]


# --- fixpoints and renamings -----------------------------------------------------------------------


@query(
    "learned_tree",
    """with recursive c as (select distinct c_custkey as node, c_custkey // 2 as parent, c_nationkey as n from customer),
r as (select node, n as value from c where node = 1 union all select c.node, (r.value * 3 + c.n) % 1000 from c join r on c.parent = r.node where c.node > 1)
select node, cast(value as bigint) as value from r""",
)
def learned_tree(spark, d):
    """Customers as callees of the customer of half their key: a caller's value gives its callees', round by round from customer 1."""
    sites = T(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("callee"), F.expr("c_custkey div 2").alias("caller"), F.col("c_nationkey").cast("long").alias("n")).where("callee > 1")
    start = T(spark, d, "customer").where("c_custkey = 1").select(F.col("c_custkey").cast("long").alias("node"), F.col("c_nationkey").cast("long").alias("value"))

    def step(new, known):
        return sites.join(new, F.col("caller") == F.col("node")).select(F.col("callee").alias("node"), ((F.col("value") * 3 + F.col("n")) % 1000).alias("value"))

    return G.learn(step, start)


def _renaming(spark, d):
    """Every supplier is renamed to the next of its nation, the last to the first."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    every = Window.partitionBy("s_nationkey")
    return T(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.coalesce(F.lead("s_suppkey").over(w), F.min("s_suppkey").over(every)).alias("other"))


_RING = "n as (select s_suppkey as name, coalesce(lead(s_suppkey) over (partition by s_nationkey order by s_suppkey), min(s_suppkey) over (partition by s_nationkey)) as other, s_nationkey, s_acctbal from supplier)"


@query("renaming_cycles", f"with {_RING} select name, other, min(name) over (partition by s_nationkey) as cycle, count(*) over (partition by s_nationkey) as length, row_number() over (partition by s_nationkey order by name) - 1 as place from n")
def renaming_cycles(spark, d):
    """The cycles of a renaming that is a permutation."""
    return G.cycles(_renaming(spark, d))


@query("renamed_suppliers", f"with {_RING} select a.name as s_suppkey, b.s_acctbal, b.s_nationkey from n a join n b on b.name = a.other")
def renamed_suppliers(spark, d):
    """All suppliers take over the balance of the one that they are renamed to, at once."""
    return G.renamed(T(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey", ["s_acctbal"], _renaming(spark, d))


# --- sweeps ---------------------------------------------------------------------------------------


@query(
    "sweep_prefixes",
    """with r as (select l_orderkey as unit, l_linenumber % 4 as run, l_partkey as k, min(l_returnflag) as v, bool_or(l_linestatus = 'O') as ok from lineitem group by 1, 2, 3),
p as (select *, row_number() over (partition by unit, run order by k) as place, dense_rank() over (partition by unit order by run) as number from r),
n as (select unit, run, number, count(*) as n from p group by 1, 2, 3),
j as (select a.unit, a.number, a.place, a.ok, b.place is null as beyond, bool_and(coalesce(a.v = b.v, false)) over (partition by a.unit, a.run order by a.place) as same from p a left join p b on b.unit = a.unit and b.number = a.number - 1 and b.place = a.place),
g as (select unit, number, count(*) filter (where same) as common, count(*) filter (where ok and beyond) as more, min(place) filter (where ok and beyond) as first from j group by 1, 2)
select a.unit, b.run as before, a.run as after, b.n as n_before, a.n as n_after, common, common = b.n as extends, case when common = b.n then more else 0 end as n_accepted, case when common = b.n and more = 1 then first end as "at"
from n a join n b on b.unit = a.unit and b.number = a.number - 1 join g on g.unit = a.unit and g.number = a.number""",
)
def sweep_prefixes(spark, d):
    """Lines of an order as runs of a sweep: how far each run repeats the one before it."""
    return W.consecutive(_sweep(spark, d), "unit", "run", "k", ["v"], F.col("ok"))


def _sweep(spark, d):
    rows = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), (F.col("l_linenumber") % 4).alias("run"), F.col("l_partkey").alias("k"))
    return rows.agg(F.min("l_returnflag").alias("v"), F.bool_or(F.col("l_linestatus") == "O").alias("ok"))


# --- a census that resumes ------------------------------------------------------------------------

ANALYSED = "unit long, cause string, n long, bytes long"


def analyse(batch):
    """What a batch of orders shows of each customer."""
    price = F.floor("o_totalprice").cast("long")
    return batch.groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("bytes"))


def census(spark, d, stop_after=None):
    """A census over the orders as a ledger of four files, one a batch; its folder, and the rows of a job that may have stopped."""
    at = folder(spark, "census")
    T(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").repartition(4).write.json(f"{at}/ledger")
    rows = spark.readStream.schema("o_custkey long, o_orderpriority string, o_totalprice double").option("maxFilesPerTrigger", 1).json(f"{at}/ledger")
    if stop_after is not None:
        try:
            K.run(rows, analyse, f"{at}/found", f"{at}/checkpoint", stop_after)
        except StreamingQueryException as e:
            if "after batch" not in str(e):
                raise
    return at, rows


def resumed(spark, at, rows):
    K.run(rows, analyse, f"{at}/found", f"{at}/checkpoint")
    return K.found(spark, f"{at}/found", _parse_datatype_string(ANALYSED))


@query("census_stream", "select o_orderpriority as cause, count(distinct o_custkey) as n_units, count(*) as n, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as bytes from orders group by 1")
def census_stream(spark, d):
    """A streamed census that stops after its second batch, uncommitted, and is resumed."""
    return K.ranking(resumed(spark, *census(spark, d, stop_after=1)), ["cause"], "n", "bytes")
