"""Classification of whole instruction arrays against brute force."""

import difflib
import random
from collections import Counter

from millrace.operators import instructions as I
from millrace.plans import catalog, catalog_code
from tests.test_code import imm, mem, pairs, reg, seq

STACK = ("rsp", "rbp")


def view(i, level):
    cls = lambda r: r if r is None or r in ("rsp", "rip") else "xmm" if r.startswith("xmm") else "gpr"

    def operand(o):
        if o.kind == "mem" and level == "frame" and o.names[0] in STACK:
            return "frame"
        name = cls if level != "exact" else lambda r: r
        return (o.kind, [name(x) for x in o.names], o.rest, o.place)

    return i.mnemonic if level == "opcodes" else (i.mnemonic, [operand(o) for o in i.operands])


def renaming(a, b):
    there, back = {}, {}
    for i, j in zip(a, b):
        x, y = ([r for o in k.operands for r in o.names] for k in (i, j))
        if len(x) != len(y) or any(there.setdefault(p, q) != q or back.setdefault(q, p) != p for p, q in zip(x, y)):
            return None
    return {p: q for p, q in there.items() if p != q}


def classify(a, b):
    for level in I.VIEWS:
        if [view(i, level) for i in a] == [view(i, level) for i in b]:
            return level, renaming(a, b) if level == "registers" else None, None, None, None
    x, y = [i.mnemonic for i in a], [i.mnemonic for i in b]
    ops = [o[1:] for o in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
    one = f"{' '.join(x[slice(*ops[0][:2])]) or '-'} / {' '.join(y[slice(*ops[0][2:])]) or '-'}" if len(ops) == 1 else None
    return "sequence", None, len(ops), sum(max(i2 - i1, j2 - j1) for i1, i2, j1, j2 in ops), one


def test_classified_equals_brute_force(spark):
    r = random.Random(2)
    step = lambda: (r.choice(["mov", "add", "cmp"]), reg(r.choice(["rax", "rbx", "xmm0"])), r.choice([imm(1), mem("rsp", r.choice([8, 16])), mem("rdi", 8)]))
    cases = [(seq(*rows), seq(*other)) for rows, other in (([step() for _ in range(r.randrange(4))], [step() for _ in range(r.randrange(4))]) for _ in range(60))]
    swap = {"rax": "rbx", "rbx": "rax"}
    for _ in range(20):
        rows = [step() for _ in range(5)]
        cases.append((seq(*rows), seq(*[(m, reg(swap.get(o[1][0], o[1][0])), p) for m, o, p in rows])))
        cases.append((seq(*rows), seq(*rows[:4], ("add", reg(r.choice(["rax", "rbx"])), rows[4][2]))))
        cases.append((seq(*rows), seq(*rows[:3], *[(m, o, mem("rsp", 24)) for m, o, _ in rows[3:]])))
    df = pairs(spark, *cases)
    want = {x.key: classify(x.ours, x.theirs) for x in df.collect()}
    assert {x[0] for x in want.values()} == {*I.VIEWS, "sequence"}
    assert {x[1] is None for x in want.values() if x[0] == "registers"} == {True, False}
    assert {x[4] is None for x in want.values() if x[0] == "sequence"} == {True, False}
    assert {x.key: (x.level, x.renaming, x.stretches, x.instructions, x.signature) for x in I.classified(df, "key").collect()} == want


def test_query_classifies_whole_arrays(spark, tmp_path):
    r = random.Random(4)
    orders = [(12 * k, k % 40, "FO"[r.randrange(2)], f"{r.randrange(1, 3)}-X") for k in range(1, 240)]
    # the same two instructions first, a difference in the third; the same three; one more on a side
    for c, f, o in ((100, "111", "112"), (101, "111", "111"), (102, "11", "111")):
        orders += [(12 * (1000 * c + 10 * n + (s == "O")), c, s, f"{p}-X") for s, side in (("F", f), ("O", o)) for n, p in enumerate(side)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    each = [classify(x.ours, x.theirs) for x in catalog_code.instructions(spark, str(tmp_path)).collect()]
    want = {level: (n, *(sum(f(x) for x in each if x[0] == level) for f in (lambda x: x[1] is not None, lambda x: x[2] or 0, lambda x: x[3] or 0))) for level, n in Counter(x[0] for x in each).items()}
    assert {x.level: (x.n, x.n_renamed, x.n_stretches, x.n_instructions) for x in catalog.QUERIES["code_agreement"](spark, str(tmp_path)).collect()} == want
