"""Descriptive tables on chains, stores and exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.groups import rows_in
from aisleframe.functions.scalars import safe_div
from aisleframe.operators.joins import attach, join_groups
from aisleframe.operators.quantiles import exact_median


def parent_summary(flags: DataFrame, focal: int) -> DataFrame:
    """Counts of chains and chain-state rows, revenue shares and presence, by quarter."""
    here = F.col("fips_state_code") == focal
    exposed = F.col("in_focal") == 1
    several = F.col("only_in_focal") == 0
    revenue = F.sum("revenue")
    return flags.groupBy("year", "quarter").agg(
        F.count(F.lit(1)).alias("n_parent_states"),
        F.sum("parent_flag").alias("n_parents"),
        F.count_if(here).alias("n_in_focal"),
        F.count_if(~several).alias("n_only_in_focal"),
        safe_div(F.sum(F.when(exposed, F.col("revenue"))), revenue).alias("exposed_revenue_share"),
        safe_div(F.sum(F.when(here, F.col("revenue"))), revenue).alias("focal_revenue_share"),
        F.avg(F.when(exposed & several & (F.col("parent_flag") == 1), F.col("presence_count")))
        .alias("mean_presence"),
        F.avg(F.when(here & several, F.col("state_sales_share"))).alias("mean_focal_share"),
    )


def focal_spillover(flags: DataFrame, focal: int) -> DataFrame:
    """Sales of focal-state chains in the other states, and each state's share in the quarter."""
    totals = flags.where((F.col("in_focal") == 1) & (F.col("fips_state_code") != focal)).groupBy(
        "year", "quarter", "fips_state_code"
    ).agg(F.sum("revenue").alias("tot_sales"))
    quarter = Window.partitionBy("year", "quarter")
    return totals.withColumn(
        "sales_share", safe_div("tot_sales", F.sum("tot_sales").over(quarter))
    )


def focal_sales_mix(flags: DataFrame, rates: DataFrame, quarter: tuple[int, int],
                    rate_year: int) -> DataFrame:
    """Where the multi-state chains of the focal state sell, weighted by chain revenue and scaled to
    one, next to each state's tax rates; states without such sales keep their rates.
    """
    year, q = quarter
    mix = flags.where(
        (F.col("in_focal") == 1) & (F.col("only_in_focal") == 0)
        & (F.col("year") == year) & (F.col("quarter") == q)
    ).groupBy("fips_state_code").agg(
        safe_div(
            F.sum(F.col("state_sales_share") * F.col("total_revenue")), F.sum("total_revenue")
        ).alias("mean_sales")
    )
    # One row per state from here on, so the unpartitioned total is over a few dozen rows.
    scaled = mix.withColumn(
        "mean_sales", safe_div("mean_sales", F.sum("mean_sales").over(Window.partitionBy()))
    )
    taxes = rates.where(F.col("year") == rate_year).select(
        F.col("statefips").alias("fips_state_code"), "t_corp", "t_x"
    )
    return scaled.join(taxes, "fips_state_code", "right")


def one_way_table(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Frequencies of a column inside each key group, and their shares."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def two_way_table(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Joint frequencies of two columns."""
    return df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, keys: Sequence[str], counts: dict[str, tuple[Column, str]]) -> DataFrame:
    """Exact distinct counts of columns under conditions, name -> (condition, column).

    The panel shrinks to one row for each combination of the counted columns first, then to one row for
    each value; no row of the panel is copied.
    """
    columns = sorted({col for _, col in counts.values()})
    cells = df.groupBy(*keys, *columns).agg(*[
        F.max(F.coalesce(cond, F.lit(False))).alias(name) for name, (cond, _) in counts.items()
    ])
    types = dict(df.dtypes)
    values = F.array(*[
        F.struct(*[(F.col(c) if c == col else F.lit(None).cast(types[c])).alias(c) for c in columns])
        for col in columns
    ])
    single = cells.select(*keys, *counts, F.explode(values).alias("_value"))
    seen = single.groupBy(*keys, "_value").agg(*[F.max(name).alias(name) for name in counts])
    return seen.groupBy(*keys).agg(*[
        F.count_if(F.col(name) & F.col("_value")[col].isNotNull()).alias(name)
        for name, (_, col) in counts.items()
    ])


def filtered_means(df: DataFrame, keys: Sequence[str], means: dict[str, tuple[Column, str]]) -> DataFrame:
    """Means of columns under conditions, name -> (condition, column)."""
    return df.groupBy(*keys).agg(*[
        F.avg(F.when(cond, F.col(col))).alias(name) for name, (cond, col) in means.items()
    ])


def first_store_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The row of each group's first store, for tables that count a chain once."""
    first = F.min_by(F.struct(*cols), "store_code_uc").alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def tag_first_store(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """parent_quarter_tag: 1 on the rows of the group's first store, else 0."""
    tagged = attach(df, keys, {"_first": F.min("store_code_uc")})
    return tagged.withColumn(
        "parent_quarter_tag", (F.col("store_code_uc") == F.col("_first")).cast("int")
    ).drop("_first")


def median_split(panel: DataFrame, base: tuple[int, int],
                 keys: Sequence[str] = ("store_code_uc", "group")) -> DataFrame:
    """Sales share at the base quarter on every row, and whether it reaches the category's median.

    The median is over one store per multi-state chain: the chain's first store in the base quarter.
    """
    at_base = (F.col("year") == base[0]) & (F.col("quarter") == base[1])
    base_rows = panel.where(at_base)
    chains = first_store_rows(
        base_rows, ["group", "parent_code"], ["state_sales_share", "only_in_focal"]
    )
    medians = exact_median(
        chains.where(F.col("only_in_focal") == 0), "state_sales_share", ["group"], "median_share"
    )
    series = Window.partitionBy(*keys)
    with_share = panel.withColumn(
        "share_base", F.max(F.when(at_base, F.col("state_sales_share"))).over(series)
    )
    return join_groups(with_share, medians, ["group"]).withColumn(
        "above_median", (F.col("share_base") >= F.col("median_share")).cast("int")
    )


def store_appearances(df: DataFrame, keys: Sequence[str] = ("store_code_uc",)) -> DataFrame:
    """Number of rows of each store on every row; the keys bound the group to a store's periods."""
    return df.withColumn("appearances", rows_in(keys))


def appearance_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often stores appear: share of rows and share of stores by number of appearances."""
    stores = df.groupBy(*keys, "store_code_uc").agg(F.count(F.lit(1)).alias("appearances"))
    table = stores.groupBy(*keys, "appearances").agg(F.count(F.lit(1)).alias("n_stores"))
    # One row per number of periods from here on.
    whole = Window.partitionBy(*keys)
    rows = F.col("appearances") * F.col("n_stores")
    return table.select(
        "*",
        rows.alias("n_rows"),
        (rows / F.sum(rows).over(whole)).alias("row_share"),
        (F.col("n_stores") / F.sum("n_stores").over(whole)).alias("store_share"),
    )


def stores_in_state(stores: DataFrame, period: str = "year") -> DataFrame:
    """Stores of each parent in each state and period, against their mean over the store-periods."""
    counts = stores.groupBy("parent_code", "fips_state_code", period).agg(
        F.count(F.lit(1)).alias("num_stores")
    )
    chain = Window.partitionBy("parent_code", "fips_state_code")
    n = F.col("num_stores")
    average = F.sum(n * n).over(chain) / F.sum(n).over(chain)
    return counts.withColumn("avg_num_stores", average).withColumn(
        "persistence", n / F.col("avg_num_stores")
    )


def store_persistence(stores: DataFrame, tolerance: float = 0.05, distance: float = 5,
                      period: str = "year") -> DataFrame:
    """Share of parent-state-periods close to the average number of stores, relative and absolute."""
    table = stores_in_state(stores, period)
    rows = F.count(F.lit(1))
    near = (F.col("persistence") > 1 - tolerance) & (F.col("persistence") < 1 + tolerance)
    close = F.abs(F.col("num_stores") - F.col("avg_num_stores")) < distance
    return table.agg(
        rows.alias("n_parent_state_periods"),
        safe_div(F.count_if(near), rows).alias("share_persistent"),
        safe_div(F.count_if(close), rows).alias("share_within_distance"),
    )
