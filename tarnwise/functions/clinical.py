"""Expressions for codes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(code: Column) -> Column:
    """A diagnosis code without dots and outer white space, in upper case; blank is null."""
    x = F.upper(F.regexp_replace(F.replace(code, F.lit("."), F.lit("")), r"^\s+|\s+$", ""))
    return F.nullif(x, F.lit(""))


def is_number(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)
