"""Exact quantiles and quantile bins that never gather an unbounded column in one task.

Order statistics of groups of any size are found in three passes: a bounded sketch brackets each wanted
rank, exact counts below and up to each bracket settle it, and the few rows inside are dealt by range and
only the ranges with a wanted rank are ranked. The sketch decides only how many rows lie inside, never
the result: a bracket that misses its rank is widened to the end of its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.operators.joins import join_groups
from aisleframe.sources.stages import stage_table

# The sketch's rank error is n / SKETCH_ACCURACY. Brackets of +-BRACKET around each probability hold the
# wanted ranks with at least two to spare where n * BRACKET is that much; else they reach to the ends.
SKETCH_ACCURACY = 100_000
BRACKET = 1e-4
SPARE = 2


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    name: str = "cuts", staged: bool = False) -> DataFrame:
    """One row per group with the array of linearly interpolated quantiles (R's type 7).

    `staged` states that df is a written table, which may be read twice.
    """
    probs = list(probs)
    values = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    if not staged:
        values = stage_table(values, "quantile-values")
    return _bracketed(values, probs, by, name)


def _bracketed(values: DataFrame, probs: Sequence[float], by: Sequence[str], name: str) -> DataFrame:
    """Three passes over a written table of values of any size."""
    lows = [max(p - BRACKET, 0.0) for p in probs]
    highs = [min(p + BRACKET, 1.0) for p in probs]
    sketch = values.groupBy(*by).agg(
        F.count("_x").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.percentile_approx("_x", lows, SKETCH_ACCURACY).alias("_lows"),
        F.percentile_approx("_x", highs, SKETCH_ACCURACY).alias("_highs"),
    )
    brackets = sketch.select(*by, F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            ((F.col("_n") - 1) * F.lit(p)).alias("h"),
            F.when((F.col("_n") * BRACKET < SPARE) | F.lit(lows[i] == 0), F.col("_min"))
            .otherwise(F.col("_lows")[i]).alias("lo"),
            F.when((F.col("_n") * BRACKET < SPARE) | F.lit(highs[i] == 1), F.col("_max"))
            .otherwise(F.col("_highs")[i]).alias("hi"),
            F.col("_min").alias("least"), F.col("_max").alias("most"),
        )
        for i, p in enumerate(probs)
    ]).alias("_b"))
    brackets = stage_table(brackets, "quantile-brackets")
    counts = _with_row(values, brackets, by).groupBy(*by).agg(F.array(*[
        F.struct(F.count_if(F.col("_x") < F.col("_b")[i]["lo"]).alias("below"),
                 F.count_if(F.col("_x") <= F.col("_b")[i]["hi"]).alias("upto"))
        for i in range(len(probs))
    ]).alias("_c"))
    settled = _with_row(brackets, counts, by).select(*by, F.zip_with("_b", "_c", _widened).alias("_b"))
    inside = _with_row(values, settled, by).select(
        *by, "_x",
        F.explode(F.filter("_b", lambda b: F.col("_x").between(b["lo"], b["hi"]))).alias("_b"),
    ).groupBy(*by, F.col("_b.i").alias("_i"), F.col("_b.h").alias("_h"),
              F.col("_b.below").alias("_below"), "_x").agg(F.count(F.lit(1)).alias("_n"))
    points = _select_ranks(inside, [*by, "_i", "_h", "_below"])
    cuts = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"])
    return points.groupBy(*by).agg(cuts.alias(name))


def _widened(b: Column, c: Column) -> Column:
    """The counted bracket, with an end that misses its rank moved to the end of the group."""
    low = c["below"] > F.floor(b["h"])
    return F.struct(
        b["i"].alias("i"), b["h"].alias("h"),
        F.when(low, b["least"]).otherwise(b["lo"]).alias("lo"),
        F.when(c["upto"] <= F.ceil(b["h"]), b["most"]).otherwise(b["hi"]).alias("hi"),
        F.when(low, 0).otherwise(c["below"]).alias("below"),
    )


def _select_ranks(inside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interpolated value at position _h of each list of distinct values _x with counts _n.

    The values are dealt by range; the counts of the ranges give each range its first rank, and only the
    ranges that hold a wanted rank are ranked, each on its own. No task sees a whole list unless it is
    as short as a range.
    """
    dealt = inside.repartitionByRange(*keys, "_x").withColumn("_range", F.spark_partition_id())
    dealt = stage_table(dealt, "quantile-ranges")
    ranges = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rows"))
    # One row for each range that a list touches from here on.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_below") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    wanted = ranges.withColumn("_before", before).where(
        (F.col("_before") <= F.ceil("_h")) & (F.col("_before") + F.col("_rows") > F.floor("_h"))
    ).drop("_rows")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_x"))
    ranked = join_groups(dealt, wanted, [*keys, "_range"]).where(
        F.col("_before").isNotNull()).withColumn("_upto", upto)
    found = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor("_h"), F.col("_x"))).alias("_lower"),
        F.min(F.when(F.col("_upto") > F.ceil("_h"), F.col("_x"))).alias("_upper"),
    )
    step = (F.col("_h") - F.floor("_h")) * (F.col("_upper") - F.col("_lower"))
    return found.withColumn("_q", F.col("_lower") + step)


def _with_row(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the one per-group row; without groups it is a scalar subquery."""
    if by:
        return join_groups(df, per_group, by)
    column = per_group.columns[0]
    return df.withColumn(column, per_group.scalar())


def exact_median(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median, one row per group."""
    return exact_quantiles(df, col, [0.5], by, name).withColumn(name, F.col(name)[0])


def bin_of(col: Column, cuts: Column, n: int) -> Column:
    """Bin 1..n of a value: right-closed intervals, the lowest value in the first."""
    inner = [F.when(col > cuts[i], 1).otherwise(0) for i in range(1, n)]
    return F.when(col.isNotNull(), sum(inner, F.lit(1)))


def quantile_bin(df: DataFrame, col: str, n: int = 5, name: str = "bin") -> DataFrame:
    """Cut the column at its n-quantiles."""
    df = stage_table(df, "quantile-bin")
    cuts = exact_quantiles(df, col, [i / n for i in range(n + 1)], name="_cuts", staged=True)
    binned = df.withColumn("_cuts", cuts.scalar())
    return binned.withColumn(name, bin_of(F.col(col), F.col("_cuts"), n)).drop("_cuts")
