"""Schemas of the input files. Column names as the files carry them."""

from __future__ import annotations

from pyspark.sql import types as T

MOVEMENT = T.StructType([
    T.StructField("store_code_uc", T.LongType()),
    T.StructField("upc", T.LongType()),
    T.StructField("week_end", T.IntegerType()),
    T.StructField("units", T.DoubleType()),
    T.StructField("prmult", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
])

STORES = T.StructType([
    T.StructField("store_code_uc", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("parent_code", T.LongType()),
    T.StructField("fips_state_code", T.IntegerType()),
])

UPC_VERSIONS = T.StructType([
    T.StructField("upc", T.LongType()),
    T.StructField("upc_ver_uc", T.IntegerType()),
    T.StructField("panel_year", T.IntegerType()),
])

TAX_RATES = T.StructType([
    T.StructField("statefips", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("t_x", T.DoubleType()),
    T.StructField("t_corp", T.DoubleType()),
    T.StructField("wgt_sales", T.DoubleType()),
])

# Product attributes that define an extras group; size2_code is read as size_code.
ATTRIBUTES = (
    "flavor_code", "form_code", "formula_code", "container_code", "salt_content_code", "style_code",
    "type_code", "product_code", "variety_code", "organic_claim_code", "common_consumer_name_code",
    "strength_code", "scent_code", "dosage_code", "gender_code", "use_code", "size_code",
)

FIRM_PANEL = T.StructType(
    [
        T.StructField("state", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("firm_id", T.LongType()),
    ]
    + [
        T.StructField(name, T.DoubleType())
        for name in (
            "cost", "wage", "rental_rate", "epsilon", "kappa", "alpha", "A", "Lbar", "rho",
            "sales_weight", "payroll_weight", "property_weight", "FA_tax_rate",
            "separate_acct_tax_rate", "sales_tax_rate", "payroll_tax_rate",
        )
    ]
)

SOLVED_COLUMNS = (
    "optimal_price", "optimal_quantity_consumed", "optimal_quantity_produced",
    "optimal_state_revenue", "optimal_state_cost", "optimal_profits", "optimal_state_profits",
)

SOLVED_PANEL = T.StructType(
    FIRM_PANEL.fields + [T.StructField(name, T.DoubleType()) for name in SOLVED_COLUMNS]
)

TRADE_COSTS = T.StructType([
    T.StructField("producing_state", T.IntegerType()),
    T.StructField("consuming_state", T.IntegerType()),
    T.StructField("firm_id", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("iceberg_trade_cost", T.DoubleType()),
    T.StructField("non_iceberg_trade_cost", T.DoubleType()),
])
