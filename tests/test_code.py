"""Causes of instruction differences on literal sequences."""

from millrace.operators import instructions as I
from pyspark.sql import functions as F


def reg(name):
    return ("reg", [name], None, None)


def imm(value):
    return ("imm", [], str(value), None)


def mem(base, disp):
    return ("mem", [base], "1x4", disp)


def seq(*rows):
    return [(i, m, list(ops)) for i, (m, *ops) in enumerate(rows)]


def pairs(spark, *cases):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], f"key long, ours array<{I.INSTRUCTION}>, theirs array<{I.INSTRUCTION}>")


def causes(spark, *cases):
    out = {}
    for r in I.differences(pairs(spark, *cases), "key").collect():
        out.setdefault(r.key, []).append((r.cause, r.rows))
    return out


def test_causes(spark):
    ret = ("ret",)
    got = causes(
        spark,
        (seq(("mov", reg("rax"), reg("rbx")), ret), seq(("mov", reg("rcx"), reg("rbx")), ret)),
        (seq(("cmp", reg("rax"), reg("rbx")), ret), seq(("cmp", reg("rbx"), reg("rax")), ret)),
        (seq(("jl", imm(1)), ret), seq(("jg", imm(1)), ret)),
        (seq(("jl", imm(1)), ret), seq(("jge", imm(1)), ret)),
        (seq(("mov", reg("rax"), mem("rsp", 8)), ret), seq(("mov", reg("rax"), mem("rsp", 16)), ret)),
        (seq(("mov", reg("rax"), mem("rdi", 8)), ret), seq(("mov", reg("rax"), mem("rdi", 16)), ret)),
        (seq(("mov", reg("rax"), imm(1)), ret), seq(("mov", reg("rax"), imm(2)), ret)),
        (seq(("call",), ret), seq(ret)),
        (seq(("nop",), ret), seq(ret)),
        ([], []),
    )
    assert got == {0: [("register-allocation", 1)], 1: [("operand-order", 1)], 2: [("operand-order", 1)], 3: [("block-order", 1)], 4: [("stack-layout", 1)], 5: [("struct-layout", 1)], 6: [("immediate-or-reloc", 1)], 7: [("inlining", 1)]}


def test_levels(spark):
    a = seq(("mov", reg("rax"), mem("rsp", 8)))
    cases = [(a, a), (a, seq(("mov", reg("rbx"), mem("rsp", 8)))), (a, seq(("mov", reg("rbx"), mem("rsp", 16)))), (a, seq(("mov", imm(1)))), (a, seq(("add", imm(1))))]
    got = {r.key: r.level for r in I.agreement(pairs(spark, *cases), "key").collect()}
    assert got == {0: "exact", 1: "registers", 2: "frame", 3: "opcodes", 4: None}


def test_padding(spark):
    one = pairs(spark, (seq(("xchg", reg("rax"), reg("rax")), ("xchg", reg("rax"), reg("rbx")), ("nop",)), [])).select(F.transform("ours", I.is_padding))
    assert one.first()[0] == [True, False, True]
