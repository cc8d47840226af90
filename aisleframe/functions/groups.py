"""Window expressions over groups whose size is bounded by the key (states of a chain, quarters of a
store). Groups without such a bound go through `operators.joins.attach`, which pre-aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from aisleframe.functions.scalars import safe_div


def share_of(value: str, keys: Sequence[str]) -> Column:
    """Share of the group total."""
    return safe_div(value, F.sum(value).over(Window.partitionBy(*keys)))


def rows_in(keys: Sequence[str]) -> Column:
    """Number of rows in the group."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys))


def flag_any(condition: Column, keys: Sequence[str]) -> Column:
    """1 on every row of a group in which the condition holds at least once, else 0."""
    return F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(Window.partitionBy(*keys))


def value_at(condition: Column, value: Column | str, keys: Sequence[str]) -> Column:
    """The group's value on the row that fulfils the condition, NULL without such a row."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(condition, value)).over(Window.partitionBy(*keys))


def mean_where(condition: Column, value: Column | str, keys: Sequence[str]) -> Column:
    """The group's mean over the rows that fulfil the condition."""
    value = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(condition, value)).over(Window.partitionBy(*keys))


def is_first(value: str, keys: Sequence[str]) -> Column:
    """Tag the row (or rows) of a group with the smallest value: the first of the sorted group."""
    return F.col(value).eqNullSafe(F.min(value).over(Window.partitionBy(*keys)))


def change_from_previous(value: str, keys: Sequence[str], order: str, digits: int = 2) -> Column:
    """Difference to the previous row of the group, which need not be the previous period."""
    window = Window.partitionBy(*keys).orderBy(order)
    return F.round(F.col(value) - F.lag(value).over(window), digits)
