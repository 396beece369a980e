"""Conditional jumps by what they mean together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The jump that holds when the operands of the comparison before it are the other way round; equality is its own.
MIRRORED = {"jl": "jg", "jg": "jl", "jle": "jge", "jge": "jle", "jb": "ja", "ja": "jb", "jbe": "jae", "jae": "jbe"}
EQUALITY = {"je": "je", "jne": "jne"}
#: The jump that holds exactly when the other doesn't.
OPPOSITE = {"jl": "jge", "jge": "jl", "jg": "jle", "jle": "jg", "jb": "jae", "jae": "jb", "ja": "jbe", "jbe": "ja", "je": "jne", "jne": "je", "js": "jns", "jns": "js", "jp": "jnp", "jnp": "jp", "jo": "jno", "jno": "jo"}


def related(table: dict[str, str], a: Column, b: Column) -> Column:
    """Is ``b`` what the table has for ``a``?"""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, a) == b, F.lit(False))
