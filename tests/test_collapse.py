from __future__ import annotations

import math

from pyspark.sql import functions as F

from aisleframe.operators import collapse, exposure, taxes

WEEKS = "store_code_uc long, upc long, week_end int, units double, prmult double, price double"


def test_weeks_to_quarters(spark, rows):
    weeks = spark.createDataFrame([
        (1, 10, 20110326, 2.0, 1.0, 3.0),
        (1, 10, 20110402, 4.0, 2.0, 3.0),
        (1, 10, 20110409, 1.0, 0.0, 3.0),
        (1, 10, 20110416, 0.0, 1.0, 3.0),
    ], WEEKS)
    out = collapse.movement_quarter(weeks)
    assert rows(out, "year", "quarter", "revenue", "quantity") == [
        (2011, 1, 6.0, 2.0), (2011, 2, 6.0, 5.0)
    ]


def test_file_year_wins_over_week_year(spark, rows):
    weeks = spark.createDataFrame([(1, 10, 20110101, 2.0, 1.0, 3.0, "0501", 2010)],
                                  WEEKS + ", group string, year int")
    out = collapse.movement_quarter(weeks)
    assert rows(out, "group", "year", "quarter", "revenue") == [("0501", 2010, 1, 6.0)]


def test_zero_quantity_has_no_price(spark, rows):
    quarterly = spark.createDataFrame(
        [(1, 10, 2011, 1, 5.0, 0.0), (1, 11, 2011, 1, 6.0, 4.0)],
        "store_code_uc long, upc long, year int, quarter int, revenue double, quantity double",
    )
    stores = spark.createDataFrame(
        [(1, 2011, 7, 6), (1, 2011, 7, 6)],
        "store_code_uc long, year int, parent_code long, fips_state_code int",
    )
    versions = spark.createDataFrame([(10, 1, 2011)], "upc long, upc_ver_uc int, year int")
    out = collapse.product_panel(quarterly, stores, versions)
    assert rows(out, "upc", "parent_code", "fips_state_code", "upc_ver_uc", "price") == [
        (10, 7, 6, 1, None), (11, 7, 6, None, 1.5)
    ]


def test_extras_groups_with_missing_attributes(spark, rows):
    keys = "store_code_uc long, upc long, year int, quarter int, group string, parent_code long, " \
        "fips_state_code int, revenue double, quantity double"
    products = spark.createDataFrame(
        [(1, u, 2011, 1, "0501", 7, 6, 1.0, 1.0) for u in (1, 2, 3, 4, 5, 6)], keys
    )
    extras = spark.createDataFrame(
        [(1, 2011, None, "a"), (2, 2011, "a", None), (3, 2011, None, None), (4, 2011, None, None),
         (6, 2011, "a", None)],
        "upc long, year int, flavor_code string, form_code string",
    )
    out = collapse.extras_collapse(products, extras, ["flavor_code", "form_code"])
    # (NULL, a) | (a, NULL) twice | no attributes, three products, one of them not in the table
    assert sorted(r.revenue for r in out.collect()) == [1.0, 2.0, 3.0]
    assert out.select("extras_group").distinct().count() == 3


def _parents(spark):
    panel = spark.createDataFrame(
        [(2011, 1, 6, 1, 30.0, 3.0), (2011, 1, 12, 1, 50.0, 5.0), (2011, 1, 41, 1, 20.0, 2.0),
         (2011, 1, 6, 2, 10.0, 1.0), (2011, 1, 12, 3, 5.0, 1.0), (2011, 2, 12, 1, 5.0, 1.0),
         (2011, 1, 6, 1, 10.0, 1.0)],
        "year int, quarter int, fips_state_code int, parent_code long, revenue double, "
        "quantity double",
    )
    return collapse.parent_state(panel)


def test_parent_state_shares_sum_to_one(spark, rows):
    parents = _parents(spark)
    sums = parents.groupBy("year", "quarter", "parent_code").agg(
        F.sum("state_sales_share").alias("s"), F.max("presence_count").alias("n"),
        F.count("*").alias("rows"),
    )
    for r in sums.collect():
        assert math.isclose(r.s, 1) and r.n == r["rows"]
    assert parents.agg(F.sum("revenue")).first()[0] == 130.0


def test_exposure_flags(spark, rows):
    flags = exposure.exposure_flags(_parents(spark), 6, (12,)).where("quarter = 1")
    assert rows(flags, "parent_code", "fips_state_code", "in_focal", "in_state_12", "only_in_focal",
                "parent_flag", "focal_share", "total_revenue") == [
        (1, 6, 1, 1, 0, 1, round(40 / 110, 9), 110.0),
        (1, 12, 1, 1, 0, 0, round(40 / 110, 9), 110.0),
        (1, 41, 1, 1, 0, 0, round(40 / 110, 9), 110.0),
        (2, 6, 1, 0, 1, 1, 1.0, 10.0),
        (3, 12, 0, 1, 0, 1, 0.0, 5.0),
    ]


def test_series_without_base_quarter_has_no_change(spark, rows):
    panel = spark.createDataFrame(
        [(1, "0501", 2010, 4, 2.0, 1.0), (1, "0501", 2011, 1, 4.0, 1.0),
         (2, "0501", 2011, 1, 4.0, 1.0), (3, "0501", 2010, 4, 0.0, 1.0),
         (3, "0501", 2011, 1, 4.0, 0.0)],
        "store_code_uc long, group string, year int, quarter int, revenue double, quantity double",
    )
    out = exposure.baseline_log_change(panel, (2010, 4))
    assert rows(out, "store_code_uc", "year", "dlprice_pre") == [
        (1, 2010, 0.0), (1, 2011, round(math.log(2), 9)), (2, 2011, None), (3, 2010, None),
        (3, 2011, None),
    ]


def test_tax_changes_lag_by_row(spark, rows):
    rates = spark.createDataFrame(
        [(6, 2006, 1.0, 5.0, 50.0), (6, 2008, 1.5, 5.0, 60.0), (6, 2009, 1.5, 0.0, 60.0),
         (7, 2008, 2.0, 0.0, 100.0)],
        "statefips int, year int, t_x double, t_corp double, wgt_sales double",
    )
    assert rows(taxes.tax_changes(rates, 2006), "statefips", "year", "dt_x", "mag") == [
        (6, 2008, 0.5, 0.5)
    ]
    assert rows(taxes.sales_weight_changes(rates, 2008), "statefips", "year", "dwgt_sales") == [
        (6, 2008, 10.0)
    ]
    assert rows(taxes.zero_tax_states(rates, 2008), "fips_state_code", "zerotax") == [
        (6, False), (7, True)
    ]


def test_frequent_groups(spark, rows):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] * 2, "group string, extras_group string")
    assert rows(collapse.frequent_groups(df, 2), "group", "extras_group") == [("a", "x")] * 3
