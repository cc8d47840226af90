"""Order tables read as a retail panel.

line items are weekly movement, suppliers are stores, nations are states, parts are products, part
types are categories. Model panels take chains as firms, so that they grow with the tables.
Suppliers and parts are keyed tables, so the dimensions made from them are joined as unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.functions.scalars import demand, markup_price, safe_div
from aisleframe.operators.collapse import (
    attach_stores,
    movement_quarter,
    movement_totals,
    parent_state,
    total_by,
)
from aisleframe.operators.scenarios import kappa_calibration

FOCAL = 6
OTHER_STATES = (12, 18, 23, 11)
WINDOW = (1996, 2000)
BASE = (1997, 4)
CUTOFF = 1998
ATTRIBUTES = ("flavor_code", "size_code")
STORE_QUARTER = ("store_code_uc", "year", "quarter")
STORE_YEARS = (1995, 2001)
TAX_YEARS = (1993, 2001)


# Columns in use; a stated schema spares the pass over the files that would infer it.
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_brand string, p_type string, p_size int",
    "nation": "n_nationkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def movement(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Weekly movement; a year window is a date range on the scan, so it reaches the files.

    The price is for as many units as the line's number says.
    """
    lines = table(spark, sf_dir, "lineitem")
    if years:
        lines = lines.where(
            (F.col("l_shipdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz"))
            & (F.col("l_shipdate") < F.lit(f"{years[1] + 1}-01-01").cast("timestamp_ntz"))
        )
    day = F.col("l_shipdate")
    return lines.select(
        F.col("l_suppkey").alias("store_code_uc"),
        F.col("l_partkey").alias("upc"),
        (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("week_end"),
        F.col("l_quantity").alias("units"),
        F.col("l_linenumber").cast("double").alias("prmult"),
        F.col("l_extendedprice").alias("price"),
    )


def with_group(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the category of their product."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("upc"), F.col("p_type").alias("group")
    )
    return df.join(parts, "upc", "left")


def quarterly(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None,
              together: Sequence[str] = ()) -> DataFrame:
    """Store x product x quarter with its category; weeks are summed before the category is joined.

    Line items hold a product of a store hardly ever twice a quarter, so dealing them unsummed, as `together`
    does, moves no more rows.
    """
    return with_group(movement_quarter(movement(spark, sf_dir, years), together), spark, sf_dir)


def parent_code(key: str) -> Column:
    """Chains of one, three and ten stores."""
    k = F.col(key)
    return (
        F.when(k % 3 == 0, k)
        .when(k % 3 == 1, 100000 + F.floor(k / 9))
        .otherwise(200000 + F.floor(k / 30))
        .cast("long")
    )


def _each_year(years: tuple[int, int]) -> Column:
    return F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store x year with parent and state."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_code_uc"),
        _each_year(STORE_YEARS).alias("year"),
        parent_code("s_suppkey").alias("parent_code"),
        F.col("s_nationkey").alias("fips_state_code"),
    )


def upc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product x year with the version number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("upc"),
        (1 + F.col("p_size") % 3).alias("upc_ver_uc"),
        _each_year(STORE_YEARS).alias("year"),
    )


def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product x year with category and two attributes, the second missing for round sizes."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("upc"),
        _each_year(STORE_YEARS).alias("year"),
        F.col("p_type").alias("group"),
        F.col("p_brand").alias("flavor_code"),
        F.when(size % 10 != 0, F.floor(size / 10)).cast("int").alias("size_code"),
    )


def _sold(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Quarters in which a store or product was sold, one row each."""
    return movement_totals(movement(spark, sf_dir), [key, "year", "quarter"]).select(key, "year", "quarter")


def store_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store dimension with a report for each quarter with sales: several rows for a store's year.

    In the second half of a year a store reports the chain of its state.
    """
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_code_uc"), F.col("s_nationkey").alias("fips_state_code")
    )
    state_chain = F.when(F.col("quarter") >= 3, 300000 + F.col("fips_state_code"))
    return _sold(spark, sf_dir, "store_code_uc").join(suppliers, "store_code_uc").withColumn(
        "parent_code", F.coalesce(state_chain, parent_code("store_code_uc")).cast("long")
    )


def version_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product versions with a report for each quarter with sales."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("upc"), "p_size")
    version = (1 + (F.col("p_size") + F.col("quarter")) % 3).alias("upc_ver_uc")
    return _sold(spark, sf_dir, "upc").join(sizes, "upc").select("upc", "year", "quarter", version)


def extras_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product attributes with a report for each quarter with sales and nothing to say which is the last."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("upc"), "p_brand", "p_size")
    flavor = F.concat_ws("-", "p_brand", (F.col("quarter") % 2).cast("string"))
    size = F.when((F.col("p_size") + F.col("quarter")) % 4 != 0, (F.col("p_size") - F.col("quarter")).cast("int"))
    return _sold(spark, sf_dir, "upc").join(brands, "upc").select(
        "upc", "year", flavor.alias("flavor_code"), size.alias("size_code")
    )


def statutory_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate rate and sales weight by state and year."""
    state, year = F.col("n_nationkey"), F.col("year")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", _each_year(TAX_YEARS).alias("year")
    ).select(
        state.alias("statefips"),
        "year",
        (state * 7 % 5 / 50.0
         + F.when((state % 4 == 2) & (year >= CUTOFF), 0.02).otherwise(0.0)).alias("t_corp"),
        (50.0 + 10 * (state % 4)
         + F.when((state % 4 == 1) & (year >= CUTOFF), 10.0).otherwise(0.0)).alias("wgt_sales"),
    )


def tax_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutory rates and the sales-tax rate paid on average, in percent of revenue."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        "l_suppkey", F.year("l_shipdate").alias("year")
    ).agg(
        F.sum(F.col("l_tax") * F.col("l_extendedprice")).alias("tax"),
        F.sum("l_extendedprice").alias("revenue"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    paid = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("statefips"), "year"
    ).agg((100 * safe_div(F.sum("tax"), F.sum("revenue"))).alias("t_x"))
    return statutory_rates(spark, sf_dir).join(paid, ["statefips", "year"], "left")


def store_groups(spark: SparkSession, sf_dir: str,
                 years: tuple[int, int] | None = None) -> DataFrame:
    """Store x category x quarter with parent and state."""
    sold = quarterly(spark, sf_dir, years, STORE_QUARTER)
    totals = total_by(sold, ["store_code_uc", "group", "year", "quarter"])
    return attach_stores(totals, stores(spark, sf_dir), unique=True)


def parents(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Parent x state x quarter; stores are collapsed before they are joined."""
    totals = movement_totals(
        movement(spark, sf_dir, years), ["store_code_uc", "year", "quarter"]
    )
    return parent_state(attach_stores(totals, stores(spark, sf_dir), unique=True))


def chain_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly revenue of each chain in each state."""
    totals = movement_totals(movement(spark, sf_dir), ["store_code_uc", "year"])
    return attach_stores(totals, stores(spark, sf_dir), unique=True).groupBy(
        F.col("parent_code").alias("firm_id"), F.col("fips_state_code").alias("state"), "year"
    ).agg(F.sum("revenue").alias("revenue"))


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain with its demand elasticity and size."""
    return chain_revenue(spark, sf_dir).groupBy("firm_id").agg(
        (F.sum("revenue") / 1000000).alias("kappa")
    ).select(
        "firm_id", (4.1 + F.col("firm_id") % 3).alias("epsilon"), "kappa",
        F.lit(1.0).alias("cost"),
    )


def firm_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain x state x year with revenue, elasticity, cost and corporate rate."""
    rates = statutory_rates(spark, sf_dir).select(
        F.col("statefips").alias("state"), "year", F.col("t_corp").alias("tax_rate")
    )
    return chain_revenue(spark, sf_dir).join(rates, ["state", "year"]).select(
        "firm_id", "state", "year", "revenue",
        (4.1 + F.col("state") % 3).alias("epsilon"),
        F.lit(1.0).alias("cost"),
        "tax_rate",
    )


def solved_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm panel with the demand shifter of the observed revenue and given prices.

    Four fifths of the tax are passed on; a few per cent of the demand stay unserved and a few of the goods
    are lost on the way, and what is produced costs more in some states than in others.
    """
    panel = kappa_calibration(firm_panel(spark, sf_dir)).drop("price", "quantity", "revenue")
    priced = panel.withColumn(
        "optimal_price", markup_price() * (1 + 0.8 * F.col("tax_rate") / F.col("epsilon"))
    ).withColumn("optimal_quantity_consumed", demand("optimal_price") * (0.95 + 0.01 * (F.col("state") % 5)))
    return priced.withColumns({
        "optimal_quantity_produced": F.col("optimal_quantity_consumed") * (1 + 0.02 * (F.col("state") % 3)),
        "optimal_state_revenue": F.col("optimal_price") * F.col("optimal_quantity_consumed"),
    }).withColumn("optimal_state_cost", F.col("cost") * (1 + 0.05 * (F.col("state") % 4))
                  * F.col("optimal_quantity_produced"))


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm panel with prices, quantities and factor use; every other state has a wage-setting firm."""
    q = F.col("optimal_quantity_consumed")
    constants = {
        "wage": 0.5, "rental_rate": 0.4, "alpha": 0.3, "A": 1.0, "Lbar": 24.5,
        "sales_weight": 0.5, "payroll_weight": 0.25, "property_weight": 0.25,
        "separate_acct_tax_rate": 0.01, "sales_tax_rate": 0.02, "payroll_tax_rate": 0.03,
    }
    return solved_panel(spark, sf_dir).select(
        "firm_id", "state", "year", "epsilon", "kappa", "cost",
        F.col("tax_rate").alias("FA_tax_rate"),
        F.col("optimal_price").alias("p"), q.alias("q"),
        (q * 0.6).alias("l"), (q * 0.4).alias("k"), (q * 0.1).alias("m"),
        F.when(F.col("state") % 2 == 0, float("inf")).otherwise(3.8).alias("rho"),
        *[F.lit(v).alias(name) for name, v in constants.items()],
    )


def trade_flows(spark: SparkSession, sf_dir: str, iceberg: float = 0.05,
                non_iceberg: float = 0.01) -> DataFrame:
    """Quantities a chain ships from the store's state to the customer's state, by year."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("year")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    shipped = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("l_suppkey", "year", F.col("c_nationkey").alias("consuming_state"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", parent_code("s_suppkey").alias("firm_id"),
        F.col("s_nationkey").alias("producing_state"),
    )
    flows = shipped.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "firm_id", "year", "producing_state", "consuming_state"
    ).agg(F.sum("quantity").alias("quantity"))
    home = F.col("producing_state") == F.col("consuming_state")
    return flows.withColumns({
        "iceberg_trade_cost": F.when(home, 0.0).otherwise(F.lit(iceberg)),
        "non_iceberg_trade_cost": F.when(home, 0.0).otherwise(F.lit(non_iceberg)),
    })
