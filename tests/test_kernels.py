"""Predicates over findings, case by case."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import findings
from millrace.operators import instructions as I
from tests.test_code import imm, pairs, reg, seq


def test_comparison_flips(spark):
    cases = [
        ("operand-order", "cmp a, b", "cmp b, a", True),
        ("operand-order", "cmp a, a", "cmp a, a", True),
        ("register-allocation", "cmp a, b", "cmp b, a", False),
        ("operand-order", "add a, b", "add b, a", False),
        ("operand-order", "cmp a, b", "cmp a, c", False),
        ("operand-order", "cmp a", "cmp a", False),
        ("block-order", "je 5", "je 5", False),
        ("block-order", "jl 5", "jg 9", True),
        ("block-order", "jae 5", "jbe 5", True),
        ("block-order", "jl 5", "jge 5", False),
        ("block-order", "ret", "ret", False),
        ("block-order", None, "jg 5", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, cause string, a string, b string, want boolean")
    got = {r.i: (bool(r.got), r.want) for r in df.withColumn("got", findings.comparison_flip(F.col("cause"), F.col("a"), F.col("b"))).collect()}
    assert all(g == bool(w) for g, w in got.values())


def test_all_but_five_write(spark):
    names = ["shl", "sar", "inc", "neg", "sete", "cmovl", "mov", "pop", "lea", "cmp", "test", "push", "jmp", "call"]
    rows = pairs(spark, (seq(*[(m, reg("rax")) for m in names], ("mov", imm(1)), ("ret",)), []))
    got = rows.select(F.transform("ours", I.written)).first()[0]
    assert got == ["rax"] * 9 + [None] * 7


def test_registers_of_theirs_by_ours(spark):
    details = ["eax->ecx, abc1->x, edx->ebx; esi->ecx", "rdi->rsi1, r12->r13", None]
    df = spark.createDataFrame([(d,) for d in details], "d string")
    assert [r[0] for r in df.select(X.arrows(F.col("d"))).collect()] == [{"ecx": "esi", "ebx": "edx"}, {}, None]
    rows = [("u", 1, "register-allocation", "eax->ecx", [4, 8], 0), ("u", 2, "register-allocation", "edx->ecx", [8], 0), ("u", 3, "register-allocation", "ebx->esi", [], 12), ("u", 4, "padding", "eax->edi", [4], 0)]
    found = spark.createDataFrame(rows, "unit string, n int, cause string, detail string, offsets array<int>, candidate int")
    got = sorted(tuple(r) for r in findings.registers_by_offset(found, ["unit"], "n").select("unit", "offset", "ours", "theirs").collect())
    assert got == [("u", 4, "ecx", "eax"), ("u", 8, "ecx", "edx"), ("u", 12, "esi", "ebx")]


def test_rows_at_checks(spark):
    schema = "key string, cause string, flip boolean, rows long, offsets array<long>, detail string"
    rows = [("a", "immediate-or-reloc", False, 3, [1, 2, 3, 4], "x"), ("a", "immediate-or-reloc", False, 2, [4], "y"), ("a", "operand-order", True, 1, [9], "z"), ("a", "inlining", False, 5, [2], "w"), ("b", "inlining", False, 2, None, "v")]
    checks = spark.createDataFrame([("a", 2), ("a", 4), ("a", 4), ("b", 1)], "key string, offset long")
    patterns = spark.createDataFrame([("a", 2, 0)], "key string, n_calls long, n_distribution long")
    got = findings.kind_evidence(spark.createDataFrame(rows, schema), "key", patterns, checks).collect()
    want = {("a", "data", "x", 2), ("a", "data", "y", 1), ("a", "enum-check", "x", 1), ("a", "enum-check", "y", 1), ("a", "comparison-flip", "z", 1), ("a", "calls", None, 2), ("a", "block-order", None, 3), ("b", "block-order", "v", 2)}
    assert {(r.key, r.kind, r.detail, r.n) for r in got} == want
