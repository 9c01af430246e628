"""Cleaning of dirty text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the spelling of a number; keeps '12d', 'inf' and 'nan' from parsing.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(col: Column) -> Column:
    """Text to double; whatever is not a plain number becomes NULL."""
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """``to_number`` on those of ``columns`` that exist; NaN in numeric ones becomes NULL."""
    kinds = dict(df.dtypes)
    present = [c for c in columns if c in kinds]
    return df.withColumns({
        c: to_number(F.col(f"`{c}`")) if kinds[c] == "string"
        else F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        for c in present
    })


def stripped(col: Column) -> Column:
    """NULL to '', surrounding white space of any kind removed."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", "")


def full_name(first: Column, last: Column) -> Column:
    return stripped(F.concat(stripped(first), F.lit(" "), stripped(last)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value in Spark and poisons averages; the data model knows NULL only."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floats})
