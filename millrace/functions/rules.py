"""Ordered rules over sets of facts, kept as data.

A fact is a named condition; the facts of a row are the names of those that hold. A rule is (name,
needed facts, excluded facts). Rules are tried in their order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Iterable[str], Iterable[str]]


def facts(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold; an unknown (null) one doesn't."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def _names(names: Iterable[str]) -> Column:
    return F.array(*map(F.lit, sorted(names))).cast("array<string>")


def applies(held: Column, needs: Iterable[str], excludes: Iterable[str] = ()) -> Column:
    """Are all needed facts held, and none of the excluded ones?"""
    needs, excludes = list(needs), list(excludes)
    return (F.size(F.array_except(_names(needs), held)) == 0) & (F.size(F.array_intersect(_names(excludes), held)) == 0)


def first_rule(held: Column, rules: list[Rule], otherwise: str | None = None) -> Column:
    """Name of the first rule that applies to the facts."""
    return F.coalesce(*[F.when(applies(held, needs, excludes), F.lit(name)) for name, needs, excludes in rules], F.lit(otherwise).cast("string"))
