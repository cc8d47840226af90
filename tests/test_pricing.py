from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from aisleframe.operators import pricing, quantiles

PANEL = "parent_code long, group string, extras_group string, year int, quarter int, " \
    "revenue double, quantity double"


def _panel(spark, rows):
    return spark.createDataFrame([(1, "0501", "x", 2011, 1, float(r), float(q)) for r, q in rows], PANEL)


def test_tied_modes_all_count(spark):
    out = pricing.uniform_price(_panel(spark, [(1, 1), (1, 1), (2, 1), (2, 1)])).first()
    assert out.mode_share == 1.0 and out.hhi == 0.5


def test_uniform_price_by_hand(spark):
    data = [(10.0, 5.0), (4.0, 2.0), (9.0, 3.0), (7.0, 0.0)]
    out = pricing.uniform_price(_panel(spark, data)).first()
    mean = (2 * 7 + 3 * 3) / 10
    sd = math.sqrt((7 * (2 - mean) ** 2 + 3 * (3 - mean) ** 2) / 9)
    assert math.isclose(out.price_mean, mean) and math.isclose(out.price_sd, sd)
    assert math.isclose(out.coef_var, sd / mean) and out.total_revenue == 30.0
    assert out.mode_share == 0.5 and math.isclose(out.hhi, (4 + 1 + 1) / 16)


def test_one_price_has_no_spread(spark):
    out = pricing.uniform_price(_panel(spark, [(0.3, 1), (0.9, 3), (2.1, 7)])).first()
    assert out.price_sd == 0.0 and out.mode_share == 1.0 and out.hhi == 1.0


def test_type_7_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (7.0,), (None,)], "x double")
    probs = [0.0, 0.2, 0.5, 1.0]
    cuts = quantiles.exact_quantiles(df, "x", probs).first().cuts
    assert cuts == pytest.approx(np.quantile([1, 2, 4, 7], probs).tolist())


def test_bracketed_quantiles_are_exact_in_large_groups(spark):
    n = 300_000
    df = spark.range(n).selectExpr(
        "if(id % 3 = 0, 'a', 'b') AS g", "(id * 7919 % 100003) * 0.5D AS x"
    ).unionByName(spark.range(5).selectExpr("string(NULL) AS g", "double(id) AS x"))
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 0.99999, 1.0]
    got = {r.g: r.cuts for r in quantiles.exact_quantiles(df, "x", probs, ["g"]).collect()}
    ids = np.arange(n)
    x = (ids * 7919 % 100003) * 0.5
    want = {"a": x[ids % 3 == 0], "b": x[ids % 3 != 0], None: np.arange(5.0)}
    for g, values in want.items():
        assert got[g] == pytest.approx(np.quantile(values, probs).tolist(), abs=1e-9), g


def test_bracketed_quantiles_with_one_dominant_value(spark):
    df = spark.range(250_000).selectExpr("if(id % 2 = 0, 1.0D, double(id)) AS x")
    ids = np.arange(250_000)
    x = np.where(ids % 2 == 0, 1.0, ids)
    probs = [0.2, 0.5, 0.51, 0.75]
    got = quantiles.exact_quantiles(df, "x", probs).first().cuts
    assert got == pytest.approx(np.quantile(x, probs).tolist())


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 4)
    monkeypatch.setattr(quantiles, "SPARE", 0)
    n = 20_000
    df = spark.range(n).selectExpr("id % 3 AS g", "double(id * id % 10007) AS x")
    ids = np.arange(n)
    x = (ids * ids % 10007).astype(float)
    probs = [0.01, 0.3, 0.5, 0.77, 0.999]
    for r in quantiles.exact_quantiles(df, "x", probs, ["g"]).collect():
        assert r.cuts == pytest.approx(np.quantile(x[ids % 3 == r.g], probs).tolist()), r.g


def test_ranges_without_a_wanted_rank_are_not_ranked(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SPARE", 10**9)
    n = 50_000
    df = spark.range(n).selectExpr("double(id * 7919 % 50021) AS x")
    x = np.arange(n) * 7919 % 50021
    got = quantiles.exact_quantiles(df, "x", [0.25, 0.5]).first().cuts
    assert got == pytest.approx(np.quantile(x, [0.25, 0.5]).tolist())
    dealt = df.selectExpr("0 AS _i", "24999.5D AS _h", "0L AS _below", "x AS _x", "1L AS _n")
    few = df.where("x < 0").selectExpr("0 AS _i", "0D AS _h", "0L AS _below", "x AS _x", "1L AS _n")
    found = quantiles._select_ranks(dealt, ["_i", "_h", "_below"]).first()
    assert found._q == pytest.approx(np.median(x))
    assert quantiles._select_ranks(few, ["_i", "_h", "_below"]).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=40))
def test_median_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = quantiles.exact_median(df, "x").first()["median"]
    assert got == pytest.approx(float(np.median(values)), rel=1e-9, abs=1e-9)


def test_quantile_bins_are_right_closed(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)] + [(None,)], "x double")
    out = quantiles.quantile_bin(df, "x", 5)
    assert rows(out.where("x IS NOT NULL"), "x", "bin") == [
        (1.0, 1), (2.0, 1), (3.0, 1), (4.0, 2), (5.0, 2), (6.0, 3), (7.0, 3), (8.0, 4), (9.0, 4),
        (10.0, 5), (11.0, 5),
    ]
    assert out.where("x IS NULL").first().bin is None
