"""Sums of doubles that do not depend on the order of the rows.

Adding doubles rounds after every step, so a total changes with the partitioning. Here each value is an
integer of at most 88 bits times a power of two that only its exponent chooses (one for every 32 exponents),
cut into two longs. The longs of one power are added as decimals, which is exact; a group has one
pair of totals for each power that occurs, 66 at most, and these are put together from the largest to the smallest.
The same values give the same bits in any number of partitions, and the result is the exact
sum up to the rounding of that last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.util import finite_or_null

_SPAN = 32  # exponents that share a power
_SHIFT = 54  # bits kept below the smallest exponent of a span (52 and two for the rounding of the logarithm)
_HALF = float(1 << 43)


def _power(n) -> Column:
    return F.pow(F.lit(2.0), n)  # exact for whole numbers


def _terms(value: Column, index: int) -> Column:
    """(index, span, high, low) of a finite value, or (index, null, value) of one that is not."""
    x = value.cast("double")
    finite = finite_or_null(x)
    span = F.coalesce(F.floor(F.floor(F.log2(F.abs(finite))) / _SPAN), F.lit(0)).cast("int")
    # in two steps, since the power alone can be beyond the largest double
    units = finite * _power(span * (-_SPAN // 2)) * _power(span * (-_SPAN // 2)) * F.lit(float(1 << _SHIFT))
    high = F.floor(units / _HALF)
    return F.when(x.isNotNull(), F.struct(
        F.lit(index).alias("index"), F.when(finite.isNotNull(), span).alias("span"), high.cast("long").alias("high"),
        (units - high * _HALF).cast("long").alias("low"),
        F.when(finite.isNull(), x).alias("odd")))


def _total(spans: Column) -> Column:
    """Sum of (span, high, low), the largest span first."""
    def add(total: Column, s: Column) -> Column:
        scale = _power(s["span"] * (_SPAN // 2))
        units = (s["high"].cast("decimal(38,0)") * F.lit(int(_HALF)).cast("decimal(14,0)")
                 + s["low"].cast("decimal(38,0)")).cast("double") / F.lit(float(1 << _SHIFT))
        return total + units * scale * scale

    return F.aggregate(F.sort_array(spans, asc=False), F.lit(0.0), add)


def exact_sums(df: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and one column a sum: like ``groupBy(keys).agg(sum)``, with a total that is the same for any partitioning.

    Nulls do not count, a sum of nothing is null, and NaN or infinite values make the sum what doubles make
    of it. Partial totals are combined before the shuffle.
    """
    names = list(sums)
    # a row without values still makes its group
    found = F.filter(F.array(*[_terms(v, i) for i, v in enumerate(sums.values())]), lambda t: t.isNotNull())
    terms = df.select(*keys, F.explode_outer(found).alias("t")).select(*keys, "t.*")
    spans = terms.groupBy(*keys, "index", "span").agg(
        F.sum(F.col("high").cast("decimal(20,0)")).alias("high"),
        F.sum(F.col("low").cast("decimal(20,0)")).alias("low"), F.sum("odd").alias("odd"))
    out = []
    for i, name in enumerate(names):
        mine = F.col("index") == i
        regular = F.collect_list(F.when(mine & F.col("span").isNotNull(), F.struct("span", "high", "low")))
        odd = F.max(F.when(mine & F.col("span").isNull(), F.col("odd")))
        out.append(F.coalesce(odd, F.when(F.size(regular) > 0, _total(regular))).alias(name))
    return spans.groupBy(*keys).agg(*out)
