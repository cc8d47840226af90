"""Scenario panels: which firms face which tax rates in which states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.scalars import markup_price, safe_div
from aisleframe.operators.joins import state_pairs, update_join
from aisleframe.operators.reshape import conditional_update


def scenario_panel(firms: DataFrame, scenarios: Sequence[tuple[int, int]],
                   constants: Mapping[str, float], base_rate: float, increase: float,
                   raising_state: int = 1) -> DataFrame:
    """Firm x year x state panel with a given number of states in each scenario year.

    scenarios holds (year, number of states). The raising state takes the equivalent sales tax in
    year 0 and the higher apportioned rate in later years.
    """
    years = F.array(*[
        F.struct(F.lit(year).alias("year"), F.sequence(F.lit(1), F.lit(n)).alias("states"))
        for year, n in scenarios
    ])
    grid = firms.withColumn("_s", F.explode(years)).select(
        *firms.columns, F.col("_s.year").alias("year"), F.explode("_s.states").alias("state")
    )
    panel = grid.withColumns(
        {name: F.lit(float(v)) for name, v in constants.items()}
        | {"FA_tax_rate": F.lit(float(base_rate)), "separate_acct_tax_rate": F.lit(0.0),
           "sales_tax_rate": F.lit(0.0), "payroll_tax_rate": F.lit(0.0)}
    )
    raising = F.col("state") == raising_state
    panel = conditional_update(
        panel, raising & (F.col("year") == 0), {"sales_tax_rate": increase / F.col("epsilon")}
    )
    return conditional_update(
        panel, raising & (F.col("year") > 0), {"FA_tax_rate": F.lit(base_rate + increase)}
    )


def grid_point(index: Column, low: float, high: float, n: int) -> Column:
    """Value of the index-th (from 0) of n evenly spaced points."""
    return low + (high - low) * index / (n - 1)


def rate_sweep(firms: DataFrame, n: int = 20, low: float = 0.0, high: float = 0.6) -> DataFrame:
    """Two states, every combination of n rates in state 1 and n rates in state 2, per firm.

    `year` numbers the combinations from 1, state 1 moving fastest. The grid is unfolded from two
    literal sequences; the rate of state 1 comes by an update join on (state, year) in the original
    formulation and is the same expression here.
    """
    points = F.sequence(F.lit(0), F.lit(n - 1))
    grid = firms.withColumn("_j", F.explode(points)).withColumn("_i", F.explode(points))
    grid = grid.withColumn("state", F.explode(F.array(F.lit(1), F.lit(2))))
    index = F.when(F.col("state") == 1, F.col("_i")).otherwise(F.col("_j"))
    return grid.withColumns({
        "year": F.col("_j") * n + F.col("_i") + 1,
        "FA_tax_rate": grid_point(index, low, high, n),
    }).drop("_i", "_j")


def set_rates(panel: DataFrame, rates: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Overwrite a rate where the rate table has the key."""
    return update_join(panel, rates, on, [column])


def trade_costs(panel: DataFrame, iceberg: float, non_iceberg: float) -> DataFrame:
    """Trade costs of every pair of the firm's states, zero inside a state."""
    pairs = state_pairs(panel)
    home = F.col("producing_state") == F.col("consuming_state")
    return pairs.withColumns({
        "iceberg_trade_cost": F.when(home, 0.0).otherwise(F.lit(float(iceberg))),
        "non_iceberg_trade_cost": F.when(home, 0.0).otherwise(F.lit(float(non_iceberg))),
    })


def kappa_calibration(df: DataFrame) -> DataFrame:
    """Demand shifter that reproduces the observed revenue at the untaxed markup price."""
    price = markup_price()
    return df.withColumn("price", price).withColumn(
        "quantity", safe_div("revenue", "price")
    ).withColumn("kappa", safe_div("quantity", F.pow(F.col("price"), -F.col("epsilon"))))


def scaled_revenue(df: DataFrame, spending: str, firm_total: float, spending_total: float) -> DataFrame:
    """Firm revenue by state in proportion to the state's consumption spending."""
    return df.withColumn("revenue", F.col(spending) * firm_total / spending_total)
