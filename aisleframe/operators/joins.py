"""Joins of the panel.

No join carries a broadcast hint, except on totals with one row per calendar year. The optimizer
broadcasts a side while its size is below `spark.sql.autoBroadcastJoinThreshold` and otherwise sorts
and merges, splitting hot keys. Small tables derived from big ones are written first, because an
aggregate's size is not known before it has run. The same holds for a table unfolded to a row for each
year, which the optimizer takes for as large as the table it came from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleframe.sources.stages import stage_table


def _same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in on]
    )


def _same_numbers(left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str) -> Column:
    """_same_keys with whole numbers compared as numbers, a missing one as 0, and only then whether both are missing.

    A hash table of one number per row takes half the memory of one that also holds which keys are missing.
    """
    def same(k: str) -> Column:
        a, b = left[k], right[f"{prefix}{k}"]
        if not all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((left, k), (right, f"{prefix}{k}"))):
            return a.eqNullSafe(b)
        return (F.coalesce(a, F.lit(0)) == F.coalesce(b, F.lit(0))) & F.when(a.isNull(), b.isNull()).otherwise(b.isNotNull())

    return reduce(lambda a, b: a & b, map(same, on))


def one_row_per_key(y: DataFrame, on: Sequence[str], cols: Sequence[str],
                    order: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Reduce y to one row per key: the last in the stated order, ties broken by the values.

    With strict, a second row for a key fails the job instead.
    """
    values = F.struct(*cols)
    picked = F.max_by(values, F.struct(*order, *cols)) if order else F.max(values)
    if strict:
        message = F.concat(F.lit("several rows for key "), F.to_json(F.struct(*on)))
        picked = F.when(F.count(F.lit(1)) == 1, picked).otherwise(F.raise_error(message))
    return y.groupBy(*on).agg(picked.alias("_values")).select(
        *on, *[F.col("_values")[c].alias(c) for c in cols]
    )


def fold_periods(y: DataFrame, on: Sequence[str], cols: Sequence[str], period: str) -> DataFrame:
    """y, which has one row per key, with the periods in which a key has the same values in one row.

    Periods are whole numbers within 2**36. `_held` has the number of a block of 32 periods in its upper half and
    a bit for each period of the block in its lower half; it is missing where the period is.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit_of(F.col(period)))
    kept = [k for k in on if k != period]
    folded = y.groupBy(*kept, *cols, _block_of(F.col(period)).alias("_block")).agg(F.bit_or(bit).alias("_bits"))
    return folded.select(*kept, *cols, F.shiftleft("_block", 32).bitwiseOR(F.col("_bits")).alias("_held"))


def _block_of(period: Column) -> Column:
    return F.floor(period / 32)


def _bit_of(period: Column) -> Column:
    return F.pmod(period, F.lit(32)).cast("int")


def _holds(held: Column, period: Column) -> Column:
    """Whether a folded row has this period; a missing one is held by a row without periods."""
    there = (F.shiftright(held, 32) == _block_of(period)) & (F.getbit(held, _bit_of(period)) == 1)
    return (period.isNull() & held.isNull()) | there


def update_join(x: DataFrame, y: DataFrame, on: Sequence[str],
                cols: Sequence[str] | Mapping[str, str], order: Sequence[str] = (),
                unique: bool = False, strict: bool = False, period: str | None = None) -> DataFrame:
    """Bring columns of y into x, keeping every row of x exactly once.

    cols maps new names to columns of y, or lists columns that keep their name. Missing keys match
    missing keys. Rows without a match get NULL in new columns and keep the old value in existing
    ones. `unique` states that y has one row per key already and saves the reduction.

    `period` names a key besides others that counts periods, such as the year. Then y is folded to one row for
    all periods with the same values and written, so that its size is known and the periods do not multiply it.
    """
    names = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    values = sorted(set(names.values()))
    source = y if unique else one_row_per_key(y, on, values, order, strict)
    same = [k for k in on if k != period]
    if period:
        source = stage_table(fold_periods(source, on, values, period), "folded")
    right = source.select(
        *[F.col(k).alias(f"_y_{k}") for k in same],
        *[F.col(src).alias(f"_v_{new}") for new, src in names.items()],
        *(["_held"] if period else []),
        F.lit(True).alias("_hit"),
    )
    match = (_same_numbers if period else _same_keys)(x, right, same, "_y_")
    if period:
        match &= _holds(right["_held"], x[period])
    joined = x.join(right, match, "left")
    updated = {
        new: F.when(F.col("_hit"), F.col(f"_v_{new}")).otherwise(F.col(new))
        if new in x.columns else F.col(f"_v_{new}")
        for new in names
    }
    kept = [updated.get(c, F.col(c)).alias(c) for c in x.columns]
    added = [updated[c].alias(c) for c in names if c not in x.columns]
    return joined.select(*kept, *added)


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a table with one row per group; missing keys match missing keys."""
    right = groups.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = df.join(right, _same_keys(df, right, keys, "_k_"), "left")
    return joined.drop(*[f"_k_{k}" for k in keys])


def attach(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row by aggregate and join, not by a window.

    Partial aggregation shrinks each group before the shuffle, so a group that holds a third of all
    rows never meets in one task. The totals are written first: with their size known they are
    broadcast when small, and the rows of df, which is read twice, are not shuffled at all.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])
    return join_groups(df, stage_table(totals, "totals"), keys)


def merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner merge on shared key columns."""
    return left.join(right, list(on), "inner")


def expand_values(df: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    """Pair every row with every value of a short literal list: a product without a join."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def repeat_rows(df: DataFrame, times: str, index: str | None = None) -> DataFrame:
    """Repeat each row `times` times, optionally numbering the copies from 1."""
    name = index or "_copy"
    copies = df.where(F.col(times) >= 1).withColumn(
        name, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    )
    return copies if index else copies.drop(name)


def state_pairs(panel: DataFrame, keys: Sequence[str] = ("firm_id", "year"),
                state: str = "state") -> DataFrame:
    """All (producing, consuming) pairs of the states a firm is in, per firm and year.

    The states of a firm-year are gathered as a set, bounded by the number of jurisdictions, and
    unfolded twice; no join, one shuffle.
    """
    states = panel.groupBy(*keys).agg(F.collect_set(state).alias("_states"))
    return (
        states.withColumn("producing_state", F.explode("_states"))
        .withColumn("consuming_state", F.explode("_states"))
        .drop("_states")
    )
