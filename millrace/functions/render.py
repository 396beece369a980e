"""Reports as lines of text, one for each row, in the order of the rows' own sort columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hexadecimal(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(number.cast("long"))))


def lines(rows: DataFrame, key: list[str], kind: str, template: str, *values: Column | str) -> DataFrame:
    """(key..., kind, line): each row's values in a ``printf`` template."""
    return rows.select(*key, F.lit(kind).alias("kind"), F.format_string(template, *values).alias("line"))


def page(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """(key..., n_lines, text): the lines of all kinds of a key in order, one under the other. A key's report is one row, so keys are units, not whole runs."""
    all_lines = parts[0]
    for p in parts[1:]:
        all_lines = all_lines.unionByName(p)
    held = F.sort_array(F.collect_list(F.struct(*order, "line")))
    out = all_lines.groupBy(*key).agg(held.alias("held"))
    return out.select(*key, F.size("held").cast("long").alias("n_lines"), F.array_join(F.transform("held", lambda x: x["line"]), "\n").alias("text"))
