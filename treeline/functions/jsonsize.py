"""Length in characters of JSON text written with ', ' and ': ' separators and no ASCII escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters written as two (backslash + letter) or as six (\u00XX).
_SHORT_ESCAPES = '"\\\n\r\t\b\f'
_LONG_ESCAPES = "".join(chr(c) for c in range(32) if chr(c) not in _SHORT_ESCAPES)


def string_size(text: Column) -> Column:
    """Characters of a JSON string literal, quotes included."""
    short = F.length(text) - F.length(F.translate(text, _SHORT_ESCAPES, ""))
    long = F.length(text) - F.length(F.translate(text, _LONG_ESCAPES, ""))
    return F.length(text) + 2 + short + 5 * long


def number_size(value: Column) -> Column:
    return F.length(value.cast("string"))


def object_size(fields: dict[str, Column]) -> Column:
    """Characters of an object with the given keys, from the sizes of its values."""
    fixed = 2 + sum(len(key) + 4 for key in fields) + 2 * (len(fields) - 1)
    total = F.lit(fixed)
    for size in fields.values():
        total = total + size
    return total


def list_size(sizes: Column) -> Column:
    """Characters of a list, from an array of the sizes of its items."""
    inner = F.aggregate(sizes, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(sizes) == 0, F.lit(2)).otherwise(inner + 2 + 2 * (F.size(sizes) - 1))
