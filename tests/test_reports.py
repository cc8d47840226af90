from __future__ import annotations

import math

from pyspark.sql import functions as F

from aisleframe.operators import reports


def test_persistence_averages_over_store_rows(spark, rows):
    stores = spark.createDataFrame(
        [(1, 6, 2010, s) for s in (1, 2)] + [(1, 6, 2011, s) for s in (1, 2, 3, 4)]
        + [(2, 6, 2010, 9)],
        "parent_code long, fips_state_code int, year int, store_code_uc long",
    )
    mean = (2 * 2 + 4 * 4) / 6
    table = reports.stores_in_state(stores)
    assert rows(table, "parent_code", "year", "num_stores", "avg_num_stores") == [
        (1, 2010, 2, round(mean, 9)), (1, 2011, 4, round(mean, 9)), (2, 2010, 1, 1.0)
    ]
    out = reports.store_persistence(stores, distance=1).first()
    assert out.n_parent_state_periods == 3
    assert math.isclose(out.share_persistent, 1 / 3)
    assert math.isclose(out.share_within_distance, 2 / 3)


def test_appearances_by_row_and_by_store(spark, rows):
    stores = spark.createDataFrame([(1, 2010), (1, 2011), (2, 2010)], "store_code_uc long, year int")
    assert rows(reports.store_appearances(stores), "store_code_uc", "appearances") == [
        (1, 2), (1, 2), (2, 1)
    ]
    table = reports.appearance_table(stores)
    assert rows(table, "appearances", "n_stores", "row_share", "store_share") == [
        (1, 1, round(1 / 3, 9), 0.5), (2, 1, round(2 / 3, 9), 0.5)
    ]


def test_median_split_counts_each_chain_once(spark, rows):
    panel = spark.createDataFrame(
        [("g", 10, 1, 2010, 4, 0.2, 0), ("g", 10, 2, 2010, 4, 0.2, 0), ("g", 20, 3, 2010, 4, 0.6, 0),
         ("g", 30, 4, 2010, 4, 0.9, 0), ("g", 40, 5, 2010, 4, 1.0, 1), ("g", 30, 4, 2011, 1, 0.1, 0),
         ("g", 50, 6, 2011, 1, 0.7, 0)],
        "group string, parent_code long, store_code_uc long, year int, quarter int, "
        "state_sales_share double, only_in_focal int",
    )
    out = reports.median_split(panel, (2010, 4))
    assert rows(out, "store_code_uc", "year", "share_base", "median_share", "above_median") == [
        (1, 2010, 0.2, 0.6, 0), (2, 2010, 0.2, 0.6, 0), (3, 2010, 0.6, 0.6, 1),
        (4, 2010, 0.9, 0.6, 1), (4, 2011, 0.9, 0.6, 1), (5, 2010, 1.0, 0.6, 1),
        (6, 2011, None, 0.6, None),
    ]


def test_tables_and_first_store(spark, rows):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 1)], "k string, x int, y int")
    assert rows(reports.one_way_table(df, ["k"], "x"), "x", "n", "share") == [
        (1, 2, round(2 / 3, 9)), (2, 1, round(1 / 3, 9))
    ]
    assert rows(reports.two_way_table(df, "x", "y"), "x", "y", "n") == [
        (1, 0, 1), (1, 1, 1), (2, 1, 1)
    ]
    stores = spark.createDataFrame([(7, 2, "b"), (7, 1, "a"), (8, 3, "c")],
                                   "parent_code long, store_code_uc long, v string")
    tagged = reports.tag_first_store(stores, ["parent_code"])
    assert rows(tagged, "store_code_uc", "parent_quarter_tag") == [(1, 1), (2, 0), (3, 1)]
    first = reports.first_store_rows(stores, ["parent_code"], ["v"])
    assert rows(first, "parent_code", "v") == [(7, "a"), (8, "c")]


def test_conditional_counts_and_means(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, None)], "k string, s int, v double")
    out = reports.distinct_counts(df, ["k"], {"all": (F.lit(True), "s"), "big": (F.col("v") > 3, "s")})
    assert (out.first()["all"], out.first()["big"]) == (2, 1)
    means = reports.filtered_means(df, ["k"], {"m": (F.col("s") == 1, "v"), "none": (F.lit(False), "v")})
    assert (means.first()["m"], means.first()["none"]) == (3.0, None)
