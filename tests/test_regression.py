from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.operators import regression, specs
from aisleframe.operators.specs import DidSpec

SCHEMA = "store_code_uc long, group string, year int, quarter int, yearqtr int, parent_code long, " \
    "x double, dlprice_pre double"


def make_rows(seed=1, stores=40, groups=("a", "b"), gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for s in range(stores):
            level, x = rng.normal(), float(rng.random() < 0.4)
            for year in range(2009, 2013):
                for q in range(1, 5):
                    if gaps and rng.random() < 0.1:
                        continue
                    y = 0.1 * level + 0.3 * x * (year >= 2011) - 0.2 * x + rng.normal() * 0.5
                    if gaps and rng.random() < 0.05:
                        y = None
                    rows.append((s, g, year, q, year * 4 + q - 1, s % 7, x,
                                 None if y is None else float(y)))
    return rows


def dense(rows, cell, cutoff=2011, keep=lambda r: True):
    """Least squares with a dummy per cell, errors clustered by store."""
    rows = [r for r in rows if r[7] is not None and r[6] is not None and keep(r)]
    y = np.array([r[7] for r in rows])
    x = np.array([r[6] for r in rows])
    z = x * np.array([r[2] >= cutoff for r in rows])
    cells = sorted({cell(r) for r in rows})
    dummies = np.array([[cell(r) == c for c in cells] for r in rows], dtype=float)
    design = np.column_stack([x, z, dummies])
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    stores = sorted({r[0] for r in rows})
    meat = np.zeros_like(inverse)
    for s in stores:
        pick = np.array([r[0] == s for r in rows])
        score = design[pick].T @ e[pick]
        meat += np.outer(score, score)
    n, k, g = len(rows), design.shape[1], len(stores)
    variance = inverse @ meat @ inverse * (n - 1) / (n - k) * g / (g - 1)
    within = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
    r2 = 1 - (e @ e) / (within @ within) * (n - len(cells)) / (n - k)
    return beta[1], math.sqrt(variance[1, 1]), n, r2


def check(row, want):
    assert row.n == want[2]
    assert (row.b, row.se, row.r2) == pytest.approx((want[0], want[1], want[3]), rel=1e-8)


def spec(name="s", sample="true", x="x", fe=("group", "yearqtr"), cutoff=2011):
    return DidSpec(name, sample, x, fe, cutoff)


def test_against_dense_least_squares(spark):
    rows = make_rows()
    panel = spark.createDataFrame(rows, SCHEMA)
    chain = spec("chain", "store_code_uc < 30", fe=("parent_code", "group", "yearqtr"))
    placebo = spec("placebo", cutoff=2010)
    out = {r.spec: r for r in regression.fe_did(panel, [spec(), placebo, chain]).collect()}
    check(out["s"], dense(rows, lambda r: (r[1], r[4])))
    check(out["placebo"], dense(rows, lambda r: (r[1], r[4]), cutoff=2010))
    check(out["chain"], dense(rows, lambda r: (r[5], r[1], r[4]), keep=lambda r: r[0] < 30))


def test_by_group_is_one_regression_each(spark):
    rows = make_rows(2)
    panel = spark.createDataFrame(rows, SCHEMA)
    out = {r.group: r for r in regression.fe_did(panel, [spec(fe=("yearqtr",))], ["group"]).collect()}
    for g in ("a", "b"):
        check(out[g], dense([r for r in rows if r[1] == g], lambda r: r[4]))


def test_row_order_partitions_and_price_scale_do_not_matter(spark):
    rows = make_rows(3, gaps=False)
    panel = spark.createDataFrame(rows, SCHEMA)
    a = regression.fe_did(panel, [spec()]).first()
    shifted = panel.orderBy(F.rand(5)).repartition(7).withColumn(
        "dlprice_pre", F.col("dlprice_pre") + math.log(3)
    )
    b = regression.fe_did(shifted, [spec()]).first()
    assert (a.b, a.se, a.r2) == pytest.approx((b.b, b.se, b.r2), rel=1e-9)


@pytest.mark.parametrize(("column", "why"), [
    ("1.0D", "x is the same everywhere"),
    ("double(yearqtr)", "x is constant inside cells"),
    ("IF(store_code_uc < 5, double(NULL), 0.0D)", "x is zero"),
    ("double(year >= 2011 AND store_code_uc < 9)", "x equals post * x"),
])
def test_no_fit_gives_null(spark, column, why):
    panel = spark.createDataFrame(make_rows(4, gaps=False), SCHEMA)
    out = regression.fe_did(panel, [spec(x=column)]).first()
    assert (out.b, out.se, out.n, out.r2) == (None,) * 4, why


def test_one_cluster_and_empty_sample_give_null_rows(spark):
    panel = spark.createDataFrame(make_rows(5, gaps=False), SCHEMA)
    out = regression.fe_did(
        panel, [spec("one", "store_code_uc = 1"), spec("none", "false"), spec("all")], ["group"]
    ).collect()
    assert {(r.group, r.spec, r.b is None) for r in out} == {
        (g, s, s != "all") for g in ("a", "b") for s in ("one", "none", "all")
    }


def test_single_row_cells_stay_in_n(spark):
    rows = make_rows(6, gaps=False) + [(99, "a", 2012, 4, 9999, 3, 1.0, 5.0)]
    out = regression.fe_did(spark.createDataFrame(rows, SCHEMA), [spec()]).first()
    check(out, dense(rows, lambda r: (r[1], r[4])))


def test_demean(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "c string, v double")
    assert rows(regression.demean(df, ["v"], ["c"]), "c", "v_d") == [
        ("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", None)
    ]


def test_catalogue():
    names = [s.name for s in specs.pooled_specs(2011)]
    assert names == [f"r{i}" for i in range(1, 14)]
    assert [s.name for s in specs.category_specs(2011)] == [
        "r1", "r2", "r3", "r4", "r5", "r6", "r7", "r2a", "r3a", "r4a"
    ]
    pooled = {s.name: s for s in specs.pooled_specs(2011)}
    assert (pooled["r11"].cutoff, pooled["r12"].cutoff, pooled["r13"].cutoff) == (2011, 2010, 2013)
    assert pooled["r6"].fe == ("parent_code", "group", "yearqtr")
