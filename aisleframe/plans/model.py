"""Tables of the apportionment model from its CSV panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.operators import apportionment, reshape
from aisleframe.sources.readers import read_panel, read_trade_costs


def solved_tables(spark: SparkSession, panel_path: str) -> dict[str, DataFrame]:
    """Markups, prices by regime and profit totals of a panel with solved prices."""
    solved = read_panel(spark, panel_path, solved=True)
    compared = apportionment.counterfactual_prices(
        solved.withColumn("tax_rate", F.col("FA_tax_rate"))
    )
    regimes = {r: f"{r}_price" for r in apportionment.REGIMES}
    return {
        "markups": apportionment.markup_table(solved),
        "prices": reshape.regime_long(compared, ["firm_id", "state", "year"], regimes),
        "profits": apportionment.profit_comparison(compared),
    }


def evaluated(panel: DataFrame, trade_path: str | None = None, flows: DataFrame | None = None) -> DataFrame:
    """After-tax profit at given prices and factors, with trade costs when flows are given."""
    if flows is None:
        return apportionment.apportioned_profit(panel)
    if trade_path:
        costs = read_trade_costs(panel.sparkSession, trade_path)
        flows = flows.join(costs, ["firm_id", "year", "producing_state", "consuming_state"])
    return apportionment.apportioned_profit(panel, flows)
