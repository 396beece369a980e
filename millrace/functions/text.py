"""Scalar expressions for evidence: keys, numbers in text, paths and message causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(value: Column) -> Column:
    """A number written in decimal or as 0x... hexadecimal; null if neither. Up to 2**64 - 1."""
    text = F.lower(F.trim(value.cast("string")))
    hexa = F.when(text.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(text, 3, 16), 16, 10))
    return F.coalesce(hexa, F.when(text.rlike("^[0-9]{1,20}$"), text)).cast("decimal(20,0)")


def function_key(symbol: Column, place: Column) -> Column:
    """A row's stable key: its symbol, or its address for a numbered clone."""
    return F.when(symbol.rlike(r"^T\.[0-9]+$") & place.isNotNull(), place).otherwise(symbol)


def slug(path: Column) -> Column:
    """A file's path as a name without separators or its source suffix."""
    return F.replace(F.regexp_replace(path, r"\.cpp$", ""), F.lit("/"), F.lit("__"))


def relative(path: Column, root: str) -> Column:
    """A path below ``root`` without it, with single separators and no ./ steps."""
    clean = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/+", "/")
    prefix = root.rstrip("/") + "/"
    return F.when(clean.startswith(prefix), F.substring(clean, F.lit(len(prefix) + 1), F.length(clean))).otherwise(clean)


def signed(word: Column, bits: int = 32) -> Column:
    """Two's complement reading of an unsigned word."""
    half, whole = 1 << (bits - 1), 1 << bits
    return F.when(word >= half, word - F.lit(whole)).otherwise(word)


def shortest(score: Column) -> Column:
    """A single-precision score as the double of its shortest decimal."""
    return score.cast("float").cast("string").cast("double")


def line_of(description: Column) -> Column:
    """The number in a leading ``line N``, else 0."""
    return F.coalesce(F.regexp_extract(description, r"^line ([0-9]+)", 1).try_cast("int"), F.lit(0))


def distance(line: Column, lines: Column) -> Column:
    """Least distance of a line to an array of lines; 0 if there are none."""
    return F.coalesce(F.array_min(F.transform(lines, lambda x: F.abs(x - line))), F.lit(0))


def callees(line: Column, keywords: list[str]) -> Column:
    """Distinct names that are called on a line, in order, without keywords or what a comment holds."""
    code = F.regexp_replace(line, r"//.*$", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z_0-9:]*)\s*\("), 1), lambda x: ~x.isin(keywords)))


def cause(message: Column, rules: list[tuple[str, str]], most: int = 80) -> Column:
    """The first rule whose pattern a message matches names its cause (``{1}`` is the first group); else its first characters, quoted names masked."""
    named = []
    for pattern, name in rules:
        head, mark, tail = name.partition("{1}")
        text = F.concat(F.lit(head), F.regexp_extract(message, pattern, 1), F.lit(tail)) if mark else F.lit(name)
        named.append((message.rlike(pattern), text))
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(named), F.substring(F.regexp_replace(message, "'[^']*'", "X"), 1, most))


def group_of(kinds: Column, signals: Column, source: list[str], without: list[str]) -> Column:
    """``source`` if any source kind or any signal; ``no source`` if all kinds are of the others; else ``other``."""
    any_source = F.arrays_overlap(kinds, F.array(*map(F.lit, source))) | (F.size(signals) > 0)
    only = (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, without)))) == 0)
    return F.when(any_source, "source").when(only, "no source").otherwise("other")


def cyclic_step(ours: Column, theirs: Column, ring: list[str]) -> Column:
    """Steps from one to the other around a ring; null if none or if either is not on it."""
    at = F.create_map(*[x for i, r in enumerate(ring) for x in (F.lit(r), F.lit(i))])
    return F.nullif(F.pmod(F.element_at(at, theirs) - F.element_at(at, ours), F.lit(len(ring))), F.lit(0))


def padded(source: Column, declaration: str, count: Column) -> Column:
    """A source with so many declarations before it."""
    return F.concat(F.repeat(F.lit(declaration), count.cast("int")), source)


#: Fixed value: a pair of registers in a finding's text.
ARROW = r"\b([a-z]{2,3}->[a-z]{2,3})\b"


def arrows(text: Column) -> Column:
    """A map of the pairs ``a->b`` of register names in a text, from b to a; of a name that has several the last counts."""
    found = F.reverse(F.regexp_extract_all(text, F.lit(ARROW), 1))
    pair = F.transform(found, lambda x: F.struct(F.split_part(x, F.lit("->"), F.lit(2)).alias("key"), F.split_part(x, F.lit("->"), F.lit(1)).alias("value")))
    keys = F.transform(pair, lambda p: p["key"])
    return F.map_from_entries(F.filter(pair, lambda p, i: F.array_position(keys, p["key"]) == i + 1))


def next_in_ring(name: Column, ring: list[str]) -> Column:
    """The element after a name on a ring; null off it."""
    at = F.array_position(F.array(*map(F.lit, ring)), name)
    return F.when(at > 0, F.element_at(F.array(*map(F.lit, ring)), (at % len(ring) + 1).cast("int")))


def table_entry(word: Column, size: int, names: list[str]) -> Column:
    """The name at a word that is a multiple of the entries' size; null if it isn't, or beyond the table."""
    k = (word / size).cast("int")
    return F.when((word >= 0) & (word % size == 0) & (word < size * len(names)), F.get(F.array(*map(F.lit, names)), k))


def section_identity(name: Column) -> Column:
    """A section that holds one symbol (``.text._Z...``) stands for the symbol; others for themselves."""
    return F.regexp_replace(name, r"^\.(?:rodata|data|bss|text)\.(?=_Z)", "")


def string_encoding(section: Column) -> Column:
    """How a merged string section is read: ``utf8`` or ``utf32le``; null if it holds no strings."""
    width = F.regexp_extract(section, r"^\.rodata\.(str\d*)(?:\.|$)", 1)
    return F.when(width == "str1", "utf8").when(width == "str4", "utf32le")


def reference_place(start: Column, addend: Column, relative: Column, trailing: Column) -> Column:
    """Where a relocation points: a field that is relative reads at its instruction's end, four bytes and any trailing field on."""
    return start + addend + F.when(relative, trailing + 4).otherwise(0)


def contract(name: Column, rules: dict[str, str]) -> Column:
    """What is known of a name by the first pattern that it matches; null if by none."""
    return F.coalesce(*[F.when(name.rlike(pattern), F.lit(text)) for pattern, text in rules.items()])


#: Library functions that return nothing whatever their callers do with it, by what their names begin with and hold.
VOID_CONTRACTS = {r"^_ZNSt(?=.*4listI)(?=.*8_M_eraseESt14_List_iterator)": "std::list::_M_erase(iterator) returns void"}


def void_contract(name: Column) -> Column:
    """What is known of a library function that returns nothing; null for others."""
    return contract(name, VOID_CONTRACTS)


def first_under(frames: Column, prefix: str, field: str = "path") -> Column:
    """The first frame of an array whose path begins with a prefix; null if none."""
    return F.get(F.filter(frames, lambda f: f[field].startswith(prefix)), F.lit(0))


#: The formats of a dump's lines. A variable ends in its version; a replacement names one and, behind the last arrow's first
#: equals sign, its value; a partition names a variable and the versions that it holds.
VERSION = r"_(\d+)(?:\([DAB]\))?"
REPLACEMENT = r"^\S+" + VERSION + r" replace with --> .*? = (.*);$"
PARTITION = r"Partition \d+ \(([^()]+) - ([\d ]+)\)"


def without_version(name: Column) -> Column:
    """A variable without its version: ``x_12`` and ``x_3(D)`` are ``x``."""
    return F.regexp_replace(name, VERSION + "$", "")


#: Comparison operators on swapped operands.
MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def same_comparison(ours: Column, operator: Column, theirs: Column, other: Column) -> Column:
    """Are two comparisons (operands, operator) one, up to versions and to swapping sides?"""
    plain = F.transform(ours, without_version)
    mirror = F.element_at(F.create_map(*[F.lit(x) for p in MIRROR.items() for x in p]), operator)
    return ((plain == theirs) & (operator == other)) | ((plain == F.reverse(theirs)) & (mirror == other))


def _told(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))


def replacements(text: Column) -> Column:
    """(version, value) of the lines of replacements."""
    part = lambda x, k: F.regexp_extract(x, REPLACEMENT, k)
    return F.transform(_told(text, REPLACEMENT), lambda x: F.struct(part(x, 1).cast("int").alias("version"), part(x, 2).alias("value")))


def partition_names(text: Column) -> Column:
    """(version, name) of the lines of partitions: each listed version has the name."""
    versions = lambda x: F.array_remove(F.split(F.regexp_extract(x, PARTITION, 2), " +"), "")
    return F.flatten(F.transform(_told(text, PARTITION), lambda x: F.transform(versions(x), lambda v: F.struct(v.cast("int").alias("version"), F.regexp_extract(x, PARTITION, 1).alias("name")))))


def reference_key(literal: Column, base: Column, place: Column) -> Column:
    """What a data reference is told by: the text of a pooled string, else its base and place."""
    return F.coalesce(F.concat(F.lit("text "), literal), F.concat_ws(" ", F.lit("at"), base.cast("string"), place.cast("string")))


def constant_key(value: Column, context: Column, text: Column) -> Column:
    """What a constant is told by: its value, where it is used and how it is written; a part that is unknown is a dash."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in (value, context, text)])
