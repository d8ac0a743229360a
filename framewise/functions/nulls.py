"""Missing-value rules that differ from SQL defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_known(condition: Column, yes, no) -> Column:
    """Choose ``yes`` or ``no``; an unknown condition gives NULL, not ``no``."""
    return F.when(condition, yes).when(~condition, no)


def blank_where_set(reason: Column, value: Column) -> Column:
    """``value`` only where no exclusion reason is set."""
    return F.when(reason.isNull(), value)


def sum_or_zero(value: Column) -> Column:
    """Sum that skips NULL and is 0 when nothing is left."""
    return F.coalesce(F.sum(value), F.lit(0))


def count_values(value: Column) -> Column:
    """Distinct count in which NULL is one more value."""
    return F.count_distinct(F.struct(value))


def share(part: Column, whole: Column) -> Column:
    """Ratio as double; NULL when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def half_even(value: Column, digits: int) -> Column:
    """Rounding in which representable ties go to the even digit."""
    return F.bround(value, digits)
