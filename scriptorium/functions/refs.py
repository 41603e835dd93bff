"""Citation paths: many spellings, one plain form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL_WIDTH = "".join(chr(0xFF10 + i) for i in range(10))


def roman_value(numeral: Column) -> Column:
    """Value of an upper-case Roman numeral (subtractive or additive); 0 for an empty string."""
    digits = F.transform(
        F.split(numeral, ""),
        lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50)
        .when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0),
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("right"))
    step = lambda a, v: F.struct(
        F.when(v < a["right"], a["total"] - v).otherwise(a["total"] + v).alias("total"), v.alias("right")
    )
    return F.aggregate(F.reverse(digits), start, step, lambda a: a["total"])


def ref_parts(ref: Column) -> Column:
    """The components of a citation path as plain strings.

    Blanks, dots, commas, colons and semicolons separate; leading zeros go; Roman numerals become
    Arabic. Null gives null, a path without components an empty array.
    """
    flat = F.regexp_replace(F.translate(ref, _FULL_WIDTH, "0123456789"), r"[\s\p{Z}.,:;]+", ".")
    parts = F.filter(F.split(flat, r"\."), lambda p: p != "")
    plain = lambda p: (
        F.when(p.rlike(r"^[0-9]+$"), F.regexp_replace(p, r"^0+(?=[0-9])", ""))
        .when(p.rlike(r"^(?i)[ivxlcdm]+$"), roman_value(F.upper(p)).cast("string"))
        .otherwise(p)
    )
    return F.transform(parts, plain)


def plain_ref(ref: Column) -> Column:
    """A citation path in Arabic numbers without leading zeros, joined by dots; null stays null."""
    return F.array_join(ref_parts(ref), ".")
