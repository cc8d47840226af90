"""How uniform prices are within a chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.scalars import safe_div, unit_price
from aisleframe.operators.quantiles import quantile_bin

UNIFORM_KEYS = ("parent_code", "group", "extras_group", "year", "quarter")


def uniform_price(df: DataFrame, keys: Sequence[str] = UNIFORM_KEYS, digits: int = 2) -> DataFrame:
    """Quantity-weighted mean and spread of rounded prices, share of rows at a modal price, and price
    concentration, per chain, product and quarter.

    Rows are first merged by rounded price, so the window that follows sees price points, not
    stores, and one exchange on the keys serves all summaries. Rows without a price count as one
    price point and leave the mean and the spread.
    """
    points = df.withColumn("price", unit_price(digits=digits)).groupBy(*keys, "price").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
    )
    chain = Window.partitionBy(*keys)
    weight = F.when(F.col("price").isNotNull(), F.col("quantity"))
    points = points.select(
        "*",
        weight.alias("w"),
        safe_div(F.sum(weight * F.col("price")).over(chain), F.sum(weight).over(chain)).alias("mean"),
        F.max("n").over(chain).alias("top"),
        F.sum("n").over(chain).alias("rows"),
    )
    spread = F.sum(F.col("w") * F.pow(F.col("price") - F.col("mean"), F.lit(2.0)))
    weights = F.sum("w")
    return points.groupBy(*keys).agg(
        F.max("mean").alias("price_mean"),
        F.when(weights > 1, F.sqrt(spread / (weights - 1))).alias("price_sd"),
        F.sum("revenue").alias("total_revenue"),
        (F.sum(F.when(F.col("n") == F.col("top"), F.col("n"))) / F.sum("n")).alias("mode_share"),
        F.sum(F.pow(F.col("n") / F.col("rows"), F.lit(2.0))).alias("hhi"),
    ).withColumn("coef_var", safe_div("price_sd", "price_mean"))


def price_concentration(uniform: DataFrame, by: Sequence[str] = ("group",)) -> DataFrame:
    """Revenue-weighted mean concentration by quarter, then the plain mean over quarters."""
    quarterly = uniform.groupBy(*by, "year", "quarter").agg(
        safe_div(F.sum(F.col("hhi") * F.col("total_revenue")), F.sum("total_revenue")).alias("hhi")
    )
    return quarterly.groupBy(*by).agg(F.avg("hhi").alias("hhi"))


def hhi_bins(uniform: DataFrame, by: Sequence[str] = ("group",), n: int = 5) -> DataFrame:
    """Categories cut into n bins of price concentration."""
    return quantile_bin(price_concentration(uniform, by), "hhi", n, "hhi_bin")
