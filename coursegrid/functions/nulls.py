"""Column helpers for the null and rounding rules the results depend on."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Round to whole numbers, halves to the even neighbour."""
    return F.bround(value, 0)


def if_known(condition: Column, yes, no) -> Column:
    """Two-way choice that is null where the condition is null."""
    return F.when(condition, yes).when(~condition, no)


def sum_known(value: Column) -> Column:
    """Sum of the known values; 0 where there are none."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def sum_all(value: Column) -> Column:
    """Sum that is null as soon as one value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def paste(sep: str, *parts: Column) -> Column:
    """Join texts, a null part written as `NA`."""
    texts = [F.coalesce(p.cast("string"), F.lit("NA")) for p in parts]
    spaced = [t for text in texts for t in (F.lit(sep), text)]
    return F.concat(*spaced[1:])


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient rounded half to even; null for a null or zero denominator."""
    return half_even(F.try_divide(numerator, denominator))


def none_if_zero(count: Column) -> Column:
    """A count as a left join would attach it: null where there is nothing to count."""
    return F.when(count != 0, count)


def excluding(column: Column, values) -> Column | None:
    """Predicate that drops the listed values and nulls; None for an empty list."""
    values = list(values)
    return ~column.isin(values) if values else None
