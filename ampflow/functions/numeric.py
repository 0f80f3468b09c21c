"""Small numeric helpers that keep clear of ANSI division errors and of NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.when(b != 0, b)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles and floats with NaN and infinities set to null, once, at ingest."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[finite(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def correlation(a: Column, b: Column) -> Column:
    """Aggregate Pearson correlation over rows where both are given; 0 where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def steps_within(gap: Column, after: int | None, before: int) -> Column:
    """The steps 0 .. ``gap`` - 1 that lie ``after`` or less from 0 or ``before`` or less from ``gap``, as an array; 0 alone without a gap, all if ``after`` is None."""
    none = F.array(F.lit(0))
    last = gap - 1
    if after is None:
        return F.when(gap > 1, F.sequence(F.lit(0), last)).otherwise(none)
    first = F.greatest(F.lit(after + 1), gap - before)
    far = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.when(gap > 1, F.concat(F.sequence(F.lit(0), F.least(F.lit(after), last)), far)).otherwise(none)
