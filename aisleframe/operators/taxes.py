"""Tax-rate changes by state and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.groups import change_from_previous


def tax_differences(rates: DataFrame, digits: int = 2) -> DataFrame:
    """Change of each rate to the state's previous row."""
    return rates.select(
        "*",
        *[
            change_from_previous(c, ["statefips"], "year", digits).alias(f"d{c}")
            for c in ("t_x", "t_corp", "wgt_sales")
        ],
    )


def tax_changes(rates: DataFrame, first_year: int) -> DataFrame:
    """Years in which the sales-tax rate moved, smallest move first."""
    changed = tax_differences(rates).where((F.col("year") >= first_year) & (F.abs("dt_x") > 0))
    return changed.withColumn("mag", F.abs("dt_x")).orderBy("mag")


def zero_tax_states(rates: DataFrame, year: int) -> DataFrame:
    """Whether each state had no corporate tax in the year."""
    return rates.where(F.col("year") == year).select(
        F.col("statefips").alias("fips_state_code"), (F.col("t_corp") == 0).alias("zerotax")
    )


def sales_weight_changes(rates: DataFrame, first_year: int, min_rise: float = 10) -> DataFrame:
    """State-years in which the sales weight of the apportionment formula rose by min_rise or more."""
    return tax_differences(rates).where(
        (F.col("dwgt_sales") >= min_rise) & (F.col("year") >= first_year)
    )
