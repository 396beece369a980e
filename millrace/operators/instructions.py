"""Sequences of decoded instructions: views of different looseness, causes of differences, levels of agreement.

An instruction is a struct (at, mnemonic, operands). An operand is a struct (kind, names, rest, place):
the registers it names, in order, its other text (a constant, a scale and width) and the displacement
of a memory operand. What a difference means is a table of rules over facts (``functions.rules``).
Sequences are arrays, aligned by ``operators.alignment``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import jumps, rules
from millrace.operators import alignment

OPERAND = "struct<kind:string,names:array<string>,rest:string,place:bigint>"
INSTRUCTION = f"struct<at:bigint,mnemonic:string,operands:array<{OPERAND}>>"

# x86-64 registers and mnemonics by property.
UNALLOCATED = ["rsp", "rip"]
FRAME = ["rsp", "rbp"]
COMMUTES = ["cmp", "test", "add", "imul", "and", "or", "xor", "addss", "addsd", "mulss", "mulsd"]
MOVES = ["mov", "movss", "movsd", "movaps", "movapd", "movq", "movd", "movzx", "movsx", "movsxd", "push", "pop"]
#: What is known of two different instructions at one place, and the cause it means.
PAIR_RULES: list[rules.Rule] = [
    ("operand-order", ["mirrored jumps"], []),
    ("block-order", ["opposite jumps"], []),
    ("operand-order", ["same mnemonic", "operands reversed"], []),
    ("stack-layout", ["same mnemonic", "same count", "frame place"], ["field place", "constant"]),
    ("struct-layout", ["same mnemonic", "same count", "field place"], ["frame place", "constant"]),
    ("immediate-or-reloc", ["same mnemonic", "same count", "constant"], ["frame place", "field place"]),
]
#: The same for a run of instructions without a counterpart.
RUN_RULES: list[rules.Rule] = [
    ("inlining", ["calls"], ["other side calls"]),
    ("inlining", ["other side calls", "three or more"], ["calls"]),
    ("register-allocation", ["moves only"], []),
    ("instruction-selection", [], ["three or more"]),
]

#: Views from strict to loose: are registers told apart, are frame places, are operands looked at?
VIEWS = {"exact": (True, True, True), "registers": (False, True, True), "frame": (False, False, True), "opcodes": (False, False, False)}


def register_class(name: Column) -> Column:
    return F.when(name.isin(UNALLOCATED), name).when(name.startswith("xmm"), "xmm").otherwise("gpr")


def _on_frame(operand: Column) -> Column:
    return (operand["kind"] == "mem") & F.coalesce(F.get(operand["names"], F.lit(0)).isin(FRAME), F.lit(False))


def view(instruction: Column, name: str) -> Column:
    """An instruction as text at one of VIEWS."""
    registers, frame, operands = VIEWS[name]
    if not operands:
        return instruction["mnemonic"]

    def text(o: Column) -> Column:
        names = o["names"] if registers else F.transform(o["names"], register_class)
        whole = F.concat(o["kind"], F.lit(":"), F.concat_ws(",", names, o["rest"], o["place"].cast("string")))
        return whole if frame else F.when(_on_frame(o), "frame").otherwise(whole)

    return F.concat_ws(" ", instruction["mnemonic"], F.transform(instruction["operands"], text))


def _operand(instruction: Column, k: int) -> Column:
    return F.get(instruction["operands"], F.lit(k))


def is_padding(instruction: Column) -> Column:
    """A nop, or an exchange of a register with itself."""
    a, b = _operand(instruction, 0), _operand(instruction, 1)
    itself = (F.size(instruction["operands"]) == 2) & (a["kind"] == "reg") & a.eqNullSafe(b)
    return (instruction["mnemonic"] == "nop") | ((instruction["mnemonic"] == "xchg") & F.coalesce(itself, F.lit(False)))


def moves_data(instruction: Column) -> Column:
    """A copy, a spill or reload, or a change of the stack pointer."""
    first = _operand(instruction, 0)
    stack = instruction["mnemonic"].isin("add", "sub") & (first["kind"] == "reg") & (F.get(first["names"], F.lit(0)) == "rsp")
    return instruction["mnemonic"].isin(MOVES) | F.coalesce(stack, F.lit(False))


#: Mnemonics that don't write their first operand.
READS = ["cmp", "test", "push", "jmp", "call"]


def written(instruction: Column) -> Column:
    """The register that an instruction writes, its first operand; null if none. All mnemonics but a few write."""
    first = _operand(instruction, 0)
    return F.when(~instruction["mnemonic"].isin(READS) & (first["kind"] == "reg"), F.get(first["names"], F.lit(0)))


def pair_facts(a: Column, b: Column) -> Column:
    """Facts of two instructions at one place."""
    x, y = a["operands"], b["operands"]
    differing = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]) & (p["x"]["kind"] == p["y"]["kind"]))
    moved = lambda p: (p["x"]["kind"] == "mem") & (p["x"]["names"] == p["y"]["names"]) & p["x"]["rest"].eqNullSafe(p["y"]["rest"])
    return rules.facts(
        {
            "mirrored jumps": jumps.related(jumps.MIRRORED | jumps.EQUALITY, a["mnemonic"], b["mnemonic"]),
            "opposite jumps": jumps.related(jumps.OPPOSITE, a["mnemonic"], b["mnemonic"]),
            "same mnemonic": a["mnemonic"] == b["mnemonic"],
            "same count": F.size(x) == F.size(y),
            "commutes": a["mnemonic"].isin(COMMUTES) & (F.size(x) == 2),
            "operands reversed": (x != y) & (x == F.reverse(y)),
            "frame place": F.exists(differing, lambda p: moved(p) & _on_frame(p["x"])),
            "field place": F.exists(differing, lambda p: moved(p) & ~_on_frame(p["x"])),
            "constant": F.exists(differing, lambda p: p["x"]["kind"] == "imm"),
        }
    )


def pair_cause(a: Column, b: Column) -> Column:
    """The cause that the facts of two different instructions mean."""
    return rules.first_rule(pair_facts(a, b), PAIR_RULES, "instruction-selection")


def run_facts(run: Column, others: Column) -> Column:
    """Facts of a run of instructions and of what stands on the other side."""
    calls = lambda c: F.exists(c, lambda i: i["mnemonic"] == "call")
    return rules.facts({"calls": calls(run), "other side calls": calls(others), "three or more": F.size(run) >= 3, "moves only": F.forall(run, moves_data)})


def differences(pairs: DataFrame, key: str, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """(key, tag, cause, offset, rows): a row for each differing place or run of two instruction arrays, padding left out.

    Sequences are aligned with registers as their class. Where this view agrees, an instruction that
    isn't the same has its operands in another order or other registers; where a region has as many
    instructions on both sides, they are compared place by place; else each side's are a run. A null
    array has no instructions.
    """
    none = F.array().cast(f"array<{INSTRUCTION}>")
    rows = pairs.select(key, *[F.filter(F.coalesce(c, none), lambda i: ~is_padding(i)).alias(n) for c, n in ((ours, "a"), (theirs, "b"))])
    aligned = alignment.opcodes(rows, key, *[F.transform(c, lambda i: view(i, "registers")) for c in "ab"])
    cut = lambda c, i, j: F.slice(c, F.col(i) + 1, F.col(j) - F.col(i)).alias(c)
    rows = rows.join(aligned, key).select(key, "tag", cut("a", "i1", "i2"), cut("b", "j1", "j2"))
    level = F.size("a") == F.size("b")
    a, b = F.col("a"), F.col("b")
    place = rows.where(level).select(key, "tag", F.inline(F.arrays_zip("a", "b"))).where(view(a, "exact") != view(b, "exact")).withColumn("held", pair_facts(a, b))
    same_view = F.when(rules.applies(F.col("held"), ["commutes", "operands reversed"]), "operand-order").otherwise("register-allocation")
    cause = F.when(F.col("tag") == "equal", same_view).otherwise(rules.first_rule(F.col("held"), PAIR_RULES, "instruction-selection"))
    out = place.select(key, "tag", cause.alias("cause"), F.col("a.at").alias("offset"), F.lit(1).alias("rows"))
    loose = rows.where(~level)
    for side, other in ("ab", "ba"):
        run = loose.where(F.size(side) > 0).withColumn("held", run_facts(F.col(side), F.col(other)))
        out = out.union(run.select(key, "tag", rules.first_rule(F.col("held"), RUN_RULES, "unknown").alias("cause"), F.get(side, F.lit(0))["at"].alias("offset"), F.size(side).alias("rows")))
    return out


def _views(instructions: str, name: str) -> Column:
    return F.transform(instructions, lambda i: view(i, name))


def agreement(pairs: DataFrame, key: str, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """(key, level): the strictest of VIEWS at which two instruction arrays agree, null at none."""
    return pairs.select(key, F.coalesce(*[F.when(_views(ours, n) == _views(theirs, n), F.lit(n)) for n in VIEWS]).alias("level"))


def classified(pairs: DataFrame, key: str, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """(key, level, renaming, stretches, instructions, signature): ``agreement`` of whole arrays, level ``sequence`` at none.

    ``renaming`` is, at level registers, the one mapping of registers that explains every difference,
    null if there is none. At level sequence the differing stretches of the opcode sequences are
    counted, with the instructions of each one's longer side; one stretch alone has a signature.
    """
    rows = pairs.join(agreement(pairs, key, ours, theirs), key)
    names = lambda c: F.transform(c, lambda i: F.flatten(F.transform(i["operands"], lambda o: o["names"])))
    codes = lambda c: F.when(F.col("level").isNull(), _views(c, "opcodes")).otherwise(F.array().cast("array<string>"))
    rows = rows.select(key, "level", codes(ours).alias("a"), codes(theirs).alias("b"), names(ours).alias("x"), names(theirs).alias("y"))
    apart = rows.where("level is null").select(key, "a", "b")
    stretches = alignment.opcodes(apart, key, F.col("a"), F.col("b")).where("tag <> 'equal'")
    longer = F.sum(F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))).cast("int")
    places = F.min(F.struct("i1", "i2", "j1", "j2"))
    stretches = stretches.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("stretches"), longer.alias("instructions"), places.alias("r"))
    rows = rows.join(stretches, key, "left")
    rows = rows.withColumn("named", F.array_distinct(F.arrays_zip(F.flatten("x").alias("x"), F.flatten("y").alias("y"))))
    once = [F.size("named") == F.size(F.array_distinct(F.flatten(c))) for c in "xy"]
    level = F.transform("x", lambda v: F.size(v)) == F.transform("y", lambda v: F.size(v))
    renaming = F.when((F.col("level") == "registers") & level & once[0] & once[1], F.map_from_entries(F.filter("named", lambda p: p["x"] != p["y"])))
    part = lambda c, i, j: F.when(F.col(f"r.{i}") == F.col(f"r.{j}"), "-").otherwise(F.array_join(F.slice(c, F.col(f"r.{i}") + 1, F.col(f"r.{j}") - F.col(f"r.{i}")), " "))
    signature = F.when(F.col("stretches") == 1, F.concat_ws(" / ", part("a", "i1", "i2"), part("b", "j1", "j2")))
    return rows.select(key, F.coalesce("level", F.lit("sequence")).alias("level"), renaming.alias("renaming"), "stretches", "instructions", signature.alias("signature"))


def level_census(classes: DataFrame, key: str, size: Column) -> tuple[DataFrame, DataFrame]:
    """(level, n, bytes) over all keys of ``classified``, and (signature, n, keys) of signatures that several keys share."""
    levels = classes.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    shared = classes.where("signature is not null").groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    return levels, shared.where("n > 1")
