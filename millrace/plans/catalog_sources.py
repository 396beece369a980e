"""Registered queries of the readers, over files that Spark first writes from the driver's tables, and of the residual census."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import bindings as B
from millrace.plans.catalog import QUERIES, query
from millrace.sources import dumps, ledger, scratch, tables


@query(
    "ledger_scan",
    """select event_type as command, user_id % 10 as unit, count(*) as n, cast(sum(event_id) as bigint) as weight from events group by 1, 2""",
)
def ledger_scan(spark, d):
    """Events as a JSON Lines ledger, read back by key columns and payload."""
    at = scratch.folder(spark, "ledger")
    events = B.table(spark, d, "events")
    ledger.record(events.select(F.col("event_type").alias("command"), (F.col("user_id") % 10).cast("string").alias("unit"), "event_id"), at)
    rows = ledger.load(spark, at).where("date is not null")
    return rows.groupBy("command", F.col("unit").cast("long").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("payload", "$.event_id", "long")).alias("weight"))


@query("symbol_table_scan", """select cast(p_partkey * 4096 as double) as address, cast(p_size as bigint) as size, p_brand || '#' || p_partkey as symbol, p_type as evidence from part""")
def symbol_table_scan(spark, d):
    """Parts as a strict symbol table, written in address order and read back."""
    at = scratch.folder(spark, "symbols")
    part = B.table(spark, d, "part")
    symbol = F.concat("p_brand", F.lit("#"), F.col("p_partkey").cast("string"))
    tables.write_symbol_table(part.select((F.col("p_partkey") * 4096).alias("address"), F.col("p_size").alias("size"), symbol.alias("symbol"), F.col("p_type").alias("evidence")), at)
    return tables.symbol_table(spark, at).withColumn("address", F.col("address").cast("double"))


@query(
    "report_scan",
    """select 'c' || o_custkey as unit, 'src/' || o_custkey || '.cpp' as source, 'o' || o_orderkey as name, cast(o_orderkey as double) as address, cast(o_custkey % 100 as bigint) as size,
  case when o_orderstatus = 'P' then 0.0 else cast(o_orderkey % 101 as double) end as score, o_orderstatus <> 'P' and o_orderkey % 101 = 100 as exact from orders""",
)
def report_scan(spark, d):
    """Orders as nested progress reports with numbers as decimal strings, flattened again."""
    at = scratch.folder(spark, "report")
    o = B.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = F.when(F.col("o_orderstatus") != "P", (k % 101).cast("double"))
    function = F.struct(F.concat(F.lit("o"), k.cast("string")).alias("name"), (c % 100).cast("string").alias("size"), score.alias("fuzzy_match_percent"), F.struct(k.cast("string").alias("virtual_address")).alias("metadata"))
    units = o.groupBy("o_custkey").agg(F.collect_list(function).alias("functions"))  # a customer's orders
    unit = F.struct(F.concat(F.lit("c"), c.cast("string")).alias("name"), "functions", F.struct(F.concat(F.lit("src/"), c.cast("string"), F.lit(".cpp")).alias("source_path")).alias("metadata"))
    units.select(F.array(unit).alias("units")).write.json(at)
    report = spark.read.schema(tables.REPORT).option("mode", "FAILFAST").json(at)
    return tables.flatten_report(report).withColumn("address", F.col("address").cast("double"))


@query(
    "residual_summary",
    """with o as (select l_orderkey, l_returnflag as kind, count(*) as n from lineitem group by l_orderkey, l_linenumber % 2, l_returnflag), k as (select l_orderkey, kind, max(n) as n from o group by all),
g as (select l_orderkey, cast(sum(n) as bigint) as n_rows, case when bool_or(kind = 'N') then 'source' when bool_and(kind = 'A') then 'no source' else 'other' end as grp from k group by 1),
j as (select grp, n_rows, cast(floor(o_totalprice) as bigint) as bytes from g join orders on o_orderkey = l_orderkey)
select coalesce(grp, 'all') as grp, count(*) as n_functions, cast(sum(n_rows) as bigint) as n_rows, cast(sum(bytes) as bigint) as bytes from j group by rollup (grp)""",
)
def residual_summary(spark, d):
    """The census by group, with a row for all."""
    groups = QUERIES["residual_rollup"](spark, d).select("l_orderkey", "n_rows", F.col("group").alias("grp"))
    sizes = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor("o_totalprice").cast("long").alias("bytes"))
    out = groups.join(sizes, "l_orderkey").rollup("grp").agg(F.count(F.lit(1)).alias("n_functions"), F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"))
    return out.withColumn("grp", F.coalesce("grp", F.lit("all")))


@query(
    "inventory_check",
    """select 'repeated keys' as finding, count(*) as n from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)
union all select 'negative sizes', count(*) from lineitem where l_quantity < 0
union all select 'unowned', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'total', count(*) from lineitem""",
)
def inventory_check(spark, d):
    """Data-quality gates of an inventory: keys that repeat, bad sizes, rows without an owner, and the total they are held against."""
    x = B.table(spark, d, "lineitem")
    twice = x.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    owned = x.join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    rest = x.agg(F.count_if(F.col("l_quantity") < 0).alias("bad"), F.count(F.lit(1)).alias("all"))
    named = lambda df, text, c="n": df.select(F.lit(text).alias("finding"), F.col(c).alias("n"))
    return named(twice, "repeated keys").union(named(rest, "negative sizes", "bad")).union(named(owned, "unowned")).union(named(rest, "total", "all"))


@query(
    "match_report_scan",
    """select 'u' || o_custkey as unit, '.text' as section, 'T.' || o_orderkey as symbol, '0x' || lower(to_hex(o_orderkey)) as key, cast(o_orderkey as double) as address, cast(o_custkey as bigint) as size, o_orderstatus = 'F' as exact from orders""",
)
def match_report_scan(spark, d):
    """Orders as match reports, a unit's sections and functions nested, and flattened again."""
    at = scratch.folder(spark, "matches")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = F.concat(F.lit("0x"), F.lower(F.hex(k)))
    function = F.struct(F.concat(F.lit("T."), k.cast("string")).alias("symbol"), place.alias("address"), c.alias("size"), F.when(F.col("o_orderstatus") == "F", True).alias("exact"))
    units = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(function).alias("functions"))
    section = F.struct(F.lit(".text").alias("name"), F.lit(False).alias("exact"), "functions")
    units.select(F.concat(F.lit("u"), c.cast("string")).alias("unit"), F.array(section).alias("sections")).write.json(at)
    return tables.flatten_matches(spark.read.schema(tables.MATCHES).json(at)).withColumn("address", F.col("address").cast("double"))


@query(
    "second_report_scan",
    """with f as (select 'c' || o_custkey as unit, 'o' || o_orderkey as name, o_custkey % 100 as size, cast(o_orderkey % 101 as double) as score, o_orderkey from orders),
b as (select 'c' || o_custkey as unit, 'o' || o_orderkey as name, cast(o_orderkey % 7 * 20 as double) as best from orders where o_orderstatus = 'F' and o_orderkey % 7 * 20 <= 100)
select f.unit, f.name, cast(size as bigint) as size, score, coalesce(best, score) as best, case when o_orderkey % 2 = 0 then cast(o_orderkey as double) end as address, coalesce(best, score) = 100 or score = 100 as exact from f left join b using (unit, name)""",
)
def second_report_scan(spark, d):
    """Orders as a report, a baseline file and a bindings file, each written, read back and joined to verdicts."""
    o = B.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("unit"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).alias("size"), "o_orderstatus")
    text = scratch.folder(spark, "bindings")
    space = F.when(F.col("k") % 2 == 0, "text").otherwise("data")
    o.select(space.alias("space"), F.concat(F.lit("0x"), F.hex("k")).alias("rva"), "name", "unit").write.csv(text, sep="\t", header=True)
    banked = scratch.folder(spark, "baseline")
    best = (F.col("k") % 7 * 20).cast("string")
    line = F.when(F.col("o_orderstatus") == "F", F.concat_ws("\t", "unit", "name", best, *[F.lit("-")] * 5)).otherwise(F.concat(F.lit("# "), "name"))
    o.where("k % 7 * 20 <= 100 or o_orderstatus <> 'F'").select(line.alias("value")).write.text(banked)
    functions = o.select("unit", "name", "size", (F.col("k") % 101).cast("double").alias("score"))
    rows = tables.with_baseline(functions, tables.baseline(spark, banked), tables.bindings(spark, text))
    return rows.select("unit", "name", "size", "score", "best", F.col("address").cast("double").alias("address"), "exact")


@query("parameter_scan", "select 'size-' || c_custkey as name, cast(case when c_custkey % 5 = 0 then c_custkey + 2 else c_nationkey end as bigint) as value from customer")
def parameter_scan(spark, d):
    """Customers as entries of a parameter dump, every fifth overridden twice."""
    at = scratch.folder(spark, "parameters")
    key = F.col("c_custkey")
    # letters only in names: digits stand after the dash
    c = B.table(spark, d, "customer").withColumn("name", F.concat(F.lit("size-"), key.cast("string")))
    c.select(F.concat(F.lit("--param "), "name", F.lit(" = "), F.col("c_nationkey").cast("string"), F.lit(" (default)")).alias("value")).write.text(at)
    fifth = c.where("c_custkey % 5 = 0")
    given = fifth.select("name", (key + 1).alias("value"), F.lit(1).alias("ord")).union(fifth.select("name", key + 2, F.lit(2)))
    return dumps.parameters(spark.read.text(at), given)


@query("memory_scan", "select cast(p_partkey * 8 as bigint) as address, cast(p_size as bigint) as word from part union all select p_partkey * 8 + 4, cast(p_partkey % 1000 as bigint) from part")
def memory_scan(spark, d):
    """Parts as lines of a memory dump, two words each, read back by address."""
    at = scratch.folder(spark, "memory")
    word = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    k = F.col("p_partkey")
    part = B.table(spark, d, "part")
    part.select(F.concat(word(k * 8), F.lit("  "), word(F.col("p_size").cast("long")), F.lit(" "), word(k % 1000)).alias("value")).write.text(at)
    return dumps.memory_words(spark.read.text(at))


@query(
    "rule_base_scan",
    """with r as (select 'c' || c_custkey as id, c_mktsegment as cause, case when c_acctbal < 0 then 'hypothesis' else 'confirmed' end as status, c_nationkey as n from customer)
select 'base' || n as base, cause, count(*) as n_rules, count(*) filter (where status = 'confirmed') as n_confirmed, min(id) as first from r where cause in ('BUILDING', 'MACHINERY') group by 1, 2""",
)
def rule_base_scan(spark, d):
    """Customers as rules, a base for each nation, written as TOML and read back; rules of two causes."""
    at = scratch.folder(spark, "rules")
    quoted = lambda name, c: F.concat(F.lit(f'{name} = "'), c, F.lit('"\n'))
    status = F.when(F.col("c_acctbal") < 0, "hypothesis").otherwise("confirmed")
    rule = F.concat(F.lit("[[idiom]]\n"), quoted("id", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), quoted("cause", F.col("c_mktsegment")), quoted("status", status))
    c = B.table(spark, d, "customer").select(F.concat(F.lit("base"), F.col("c_nationkey").cast("string")).alias("base"), rule.alias("value"))
    c.write.partitionBy("base").text(at)
    files = spark.read.format("binaryFile").load(at).select("base", "content")
    wanted = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "cause string")
    rows = tables.rules_for(tables.rule_bases(files), wanted)
    return rows.groupBy("base", "cause").agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("status") == "confirmed").alias("n_confirmed"), F.min("id").alias("first"))
