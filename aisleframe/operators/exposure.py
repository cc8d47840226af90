"""Exposure of chains to a focal state, and the panel the regressions run on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aisleframe.functions.groups import flag_any, is_first, mean_where, value_at
from aisleframe.functions.scalars import safe_ln, unit_price, year_quarter
from aisleframe.operators.joins import attach, update_join

CHAIN = ("year", "quarter", "parent_code")
EXPOSURE_COLUMNS = ("state_sales_share", "presence_count", "in_focal", "only_in_focal", "focal_share")


def exposure_flags(parents: DataFrame, focal: int, others: Sequence[int] = ()) -> DataFrame:
    """Presence flags, focal-state share and total revenue on every row of a parent's quarter.

    All windows share the exchange on (year, quarter, parent); a group has one row per state.
    """
    state = F.col("fips_state_code")
    in_focal = flag_any(state == focal, CHAIN)
    return parents.select(
        "*",
        in_focal.alias("in_focal"),
        *[flag_any(state == s, CHAIN).alias(f"in_state_{s}") for s in others],
        F.when(F.col("presence_count") == 1, in_focal).otherwise(0).alias("only_in_focal"),
        is_first("fips_state_code", CHAIN).cast("int").alias("parent_flag"),
        F.coalesce(value_at(state == focal, "state_sales_share", CHAIN), F.lit(0.0))
        .alias("focal_share"),
        F.sum("revenue").over(Window.partitionBy(*CHAIN)).alias("total_revenue"),
    )


def baseline_log_change(df: DataFrame, base: tuple[int, int],
                        keys: Sequence[str] = ("store_code_uc", "group")) -> DataFrame:
    """Price, log price and its change since the base quarter, NULL for a series without one."""
    base_row = (F.col("year") == base[0]) & (F.col("quarter") == base[1])
    priced = df.withColumn("yearqtr", year_quarter()).withColumn("price", unit_price())
    priced = priced.withColumn("lprice", safe_ln("price"))
    return priced.withColumn(
        "dlprice_pre", F.col("lprice") - value_at(base_row, "lprice", keys)
    )


def exposure_panel(panel: DataFrame, flags: DataFrame, zero_tax: DataFrame, base: tuple[int, int],
                   cutoff: int, keys: Sequence[str] = ("store_code_uc", "group"),
                   share_keys: Sequence[str] | None = None,
                   extra: Sequence[str] = ()) -> DataFrame:
    """Panel with exposure, zero-tax flag, price change and mean exposure before the cutoff.

    `keys` name one series of quarters, so the windows, which come after the joins and share one
    exchange, see a few dozen rows per group. `share_keys` may be coarser, with no bound on their
    rows; then the mean is aggregated and joined back, and panel, which should be a written table,
    is read twice.
    """
    columns = {c: c for c in (*EXPOSURE_COLUMNS, *extra)} | {"gross_revenue": "revenue"}
    joined = update_join(
        panel, flags, ["year", "quarter", "parent_code", "fips_state_code"], columns, unique=True
    )
    joined = update_join(joined, zero_tax, ["fips_state_code"], ["zerotax"], unique=True)
    before = F.col("year") < cutoff
    if share_keys is None or tuple(share_keys) == tuple(keys):
        return baseline_log_change(joined, base, keys).withColumn(
            "focal_share_pre", mean_where(before, "focal_share", keys)
        )
    joined = attach(
        joined, share_keys, {"focal_share_pre": F.avg(F.when(before, F.col("focal_share")))}
    )
    return baseline_log_change(joined, base, keys)
