"""Small column helpers shared by all function modules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """Column names become ``col``, Python scalars become literals, columns pass."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def finite_or_null(x) -> Column:
    """NaN and ±infinity become null; everything else passes."""
    x = as_col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def fixed_point_text(scaled, scale: int) -> Column:
    """Text of an integer held in units of 10^-scale, e.g. (-1234, 2) -> '-12.34'.

    Exact decimals up to ``scale`` 6, so the text is the same in every SQL engine.
    """
    unit = F.lit(Decimal(1).scaleb(-scale))
    return (as_col(scaled).cast("long").cast("decimal(20,0)") * unit).cast("string")


def plain_number(x) -> Column:
    """Decimal text without exponent, up to 10 decimals: 9e-4 -> '0.0009', 100 -> '100.0'."""
    x = as_col(x).cast("double")
    txt = x.cast("decimal(24,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(txt, "0+$", ""), r"\.$", ".0")
