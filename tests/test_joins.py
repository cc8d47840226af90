from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aisleframe.operators import joins, reshape


def test_update_join_keeps_every_row_once(spark, rows):
    x = spark.createDataFrame([(1, 2010, 5), (1, 2011, 6), (2, 2010, 7)], "s int, year int, v int")
    y = spark.createDataFrame(
        [(1, 2010, "a", 1), (1, 2010, "b", 2), (3, 2010, "c", 3)], "s int, year int, p string, o int"
    )
    out = joins.update_join(x, y, ["s", "year"], ["p"], order=["o"])
    assert rows(out, "s", "year", "v", "p") == [
        (1, 2010, 5, "b"), (1, 2011, 6, None), (2, 2010, 7, None)
    ]


def test_update_join_order_is_stated_not_physical(spark, rows):
    x = spark.createDataFrame([(1,)], "s int")
    y = spark.createDataFrame([(1, "a", 9), (1, "b", 2)], "s int, p string, o int")
    assert rows(joins.update_join(x, y, ["s"], ["p"], order=["o"]), "p") == [("a",)]
    assert rows(joins.update_join(x, y, ["s"], {"q": "p"}), "s", "q") == [(1, "b")]


def test_update_join_matches_missing_keys_and_keeps_old_values(spark, rows):
    x = spark.createDataFrame([(None, 1.0), (2, 2.0), (3, 3.0)], "s int, rate double")
    y = spark.createDataFrame([(None, 9.0), (3, None)], "s int, rate double")
    out = joins.update_join(x, y, ["s"], ["rate"], unique=True)
    assert rows(out, "s", "rate") == [(2, 2.0), (3, None), (None, 9.0)]


def test_strict_update_join_fails_on_a_second_row(spark):
    x = spark.createDataFrame([(1,)], "s int")
    y = spark.createDataFrame([(1, "a"), (1, "b")], "s int, p string")
    with pytest.raises(PySparkException, match="several rows"):
        joins.update_join(x, y, ["s"], ["p"], strict=True).collect()


def test_attach_groups_missing_keys(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 7)], "k string, v int")
    out = joins.attach(df, ["k"], {"total": F.sum("v")})
    assert rows(out, "k", "v", "total") == [("a", 1, 3), ("a", 2, 3), (None, 5, 12), (None, 7, 12)]


def test_state_pairs_and_repeats(spark, rows):
    panel = spark.createDataFrame(
        [(1, 0, 1), (1, 0, 2), (1, 0, 2), (2, 0, 5)], "firm_id int, year int, state int"
    )
    pairs = joins.state_pairs(panel)
    assert rows(pairs, "firm_id", "producing_state", "consuming_state") == [
        (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (2, 5, 5)
    ]
    kinds = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0)], "kind string, n int")
    assert rows(joins.repeat_rows(kinds, "n"), "kind") == [("a",), ("b",), ("b",), ("b",)]
    assert rows(joins.repeat_rows(kinds, "n", "i"), "kind", "i") == [
        ("a", 1), ("b", 1), ("b", 2), ("b", 3)
    ]


def test_reshape(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k int, a_price double, b_price double")
    long = reshape.regime_long(df, ["k"], {"a": "a_price", "b": "b_price"})
    assert rows(long, "k", "regime", "price") == [
        (1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 4.0)
    ]
    union = reshape.relabel_union(df, F.col("k") == 1, {"a_price": F.lit(0.0)})
    assert rows(union, "k", "a_price") == [(1, 0.0), (1, 1.0), (2, 3.0)]
    updated = reshape.conditional_update(df, F.col("k") == 2, {"a_price": F.lit(9.0), "c": F.lit(1)})
    assert rows(updated, "k", "a_price", "c") == [(1, 1.0, None), (2, 9.0, 1)]


def test_as_doubles(spark):
    df = spark.createDataFrame([("0501", 3, "2.5")], "group string, n int, b string")
    out = reshape.as_doubles(df, ["group"])
    assert tuple(out.first()) == ("0501", 3.0, 2.5)
