from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from aisleframe.operators import apportionment, scenarios
from aisleframe.sources.schemas import FIRM_PANEL

STATES = [
    # state, tax_rate, epsilon, kappa, cost, price
    (1, 0.10, 6.0, 1.0, 1.0, 1.22), (2, 0.30, 4.0, 2.0, 1.0, 1.41), (3, 0.0, 5.0, 3.0, 0.9, 1.1),
]


@pytest.fixture
def panel(spark):
    rows = [(1, y, *s) for y in (0, 1) for s in STATES]
    return spark.createDataFrame(
        rows, "firm_id long, year int, state int, tax_rate double, epsilon double, kappa double, "
        "cost double, optimal_price double"
    ).withColumns({"optimal_quantity_consumed": 5.0 + F.col("state"),
                   "optimal_state_revenue": F.lit(7.0) * F.col("state")})


def test_the_optimal_regime_takes_the_given_columns(panel):
    out = {r.state: r for r in apportionment.counterfactual_prices(panel).where("year = 0").collect()}
    total = sum(7.0 * s for s, *_ in STATES)
    profit = sum((5.0 + s) * (price - cost) for s, _, _, _, cost, price in STATES)
    for s, t, _, _, cost, price in STATES:
        assert math.isclose(out[s].optimal_quantity, 5.0 + s)
        assert math.isclose(out[s].optimal_state_profits, (5.0 + s) * (price - cost))
        assert math.isclose(out[s].optimal_state_tax_bill, 7.0 * s / total * t * profit)


def test_counterfactuals_by_hand(panel):
    out = {r.state: r for r in apportionment.counterfactual_prices(panel).where("year = 0").collect()}
    total = profit = 0.0
    for s, t, eps, kappa, cost, _ in STATES:
        price = eps / (eps - 1) * cost * (1 + t / eps)
        q = kappa * price**-eps
        total += price * q
        profit += q * (price - cost)
        r = out[s]
        assert math.isclose(r.perceived_sales_tax_price, price)
        assert math.isclose(r.naive_price, eps / (eps - 1) * cost)
        assert math.isclose(r.sales_tax_consumer_price, price)
        assert math.isclose(r.sales_tax_quantity, q)
        assert math.isclose(r.sales_tax_profits, q * (r.naive_price - cost))
    for s, t, *_ in STATES:
        r = out[s]
        share = r.perceived_sales_tax_price * r.perceived_sales_tax_quantity / total
        assert math.isclose(r.perceived_sales_tax_sales_share, share)
        assert math.isclose(r.perceived_sales_tax_state_tax_bill, share * t * profit)


def test_sales_shares_sum_to_one_and_totals_agree(panel):
    out = apportionment.counterfactual_prices(panel)
    for regime in apportionment.REGIMES:
        for r in out.groupBy("year").agg(F.sum(f"{regime}_sales_share").alias("s")).collect():
            assert math.isclose(r.s, 1)
    totals = {r.year: r for r in apportionment.profit_comparison(out).collect()}
    by_hand = sum(
        r.naive_state_profits - r.naive_state_tax_bill for r in out.where("year = 1").collect()
    )
    assert math.isclose(totals[1].total_post_tax_naive_profits, by_hand)


def test_the_two_markups_agree_when_costs_are_uniform(spark):
    df = spark.createDataFrame(
        [(1, 0, s, p, q, q, p * q, 2.0 * q) for s, p, q in ((1, 3.0, 5.0), (2, 2.5, 8.0))],
        "firm_id long, year int, state int, optimal_price double, optimal_quantity_consumed double, "
        "optimal_quantity_produced double, optimal_state_revenue double, optimal_state_cost double",
    )
    for r in apportionment.markup_table(df).collect():
        assert math.isclose(r.firm_markup, (15 + 20) / 26 - 1)
        assert math.isclose(r.firm_weighted_markup, r.firm_markup)


def test_the_two_markups_differ_with_costs_and_losses(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, 3.0, 5.0, 6.0, 15.0, 12.0), (1, 0, 2, 2.5, 8.0, 8.0, 20.0, 4.0)],
        "firm_id long, year int, state int, optimal_price double, optimal_quantity_consumed double, "
        "optimal_quantity_produced double, optimal_state_revenue double, optimal_state_cost double",
    )
    for r in apportionment.markup_table(df).collect():
        assert math.isclose(r.firm_markup, 35 / 16 - 1)
        assert math.isclose(r.firm_weighted_markup, (0.5 * 5 + 4.0 * 8) / 13)


FACTORS = "firm_id long, year int, state int, epsilon double, kappa double, cost double, " \
    "FA_tax_rate double, p double, q double, l double, k double, m double, rho double, wage double, " \
    "rental_rate double, alpha double, A double, Lbar double, sales_weight double, " \
    "payroll_weight double, property_weight double, separate_acct_tax_rate double, " \
    "sales_tax_rate double, payroll_tax_rate double"


def _factors(spark, weights=(0.5, 0.25, 0.25), rates=(0.01, 0.02, 0.03)):
    inf = float("inf")
    rows = [
        (1, 0, 1, 6.0, 1.0, 1.5, 0.1, 1.2, 3.0, 2.0, 1.0, 0.5, inf, 0.4, 0.3, 0.3, 1.0, 27.0,
         *weights, *rates),
        (1, 0, 2, 6.0, 1.0, 1.5, 0.4, 1.4, 2.0, 1.5, 2.0, 0.2, 3.8, 0.4, 0.3, 0.3, 1.0, 27.0,
         *weights, *rates),
    ]
    return rows, spark.createDataFrame(rows, FACTORS)


def test_apportioned_profit_by_hand(spark):
    rows, df = _factors(spark)
    sales = [r[7] * r[8] for r in rows]
    wages = [0.4, (1.5 / 27) ** (1 / 3.8)]
    payroll = [w * r[9] for w, r in zip(wages, rows, strict=True)]
    prop = [0.3 * r[10] for r in rows]
    cost = [a + b + 1.5 * r[11] for a, b, r in zip(payroll, prop, rows, strict=True)]
    rate = sum(
        t * (0.5 * s / sum(sales) + 0.25 * w / sum(payroll) + 0.25 * k / sum(prop))
        for t, s, w, k in zip((0.1, 0.4), sales, payroll, prop, strict=True)
    )
    profit = sum(sales) - sum(cost)
    other = 0.01 * profit + 0.02 * sum(sales) + 0.03 * sum(payroll)
    out = apportionment.apportioned_profit(df).first()
    assert math.isclose(out.apportioned_rate, rate)
    assert math.isclose(out.naive_rate, 0.25)
    assert math.isclose(out.after_tax_profit, (1 - rate) * profit - other)
    assert math.isclose(out.after_tax_profit_naive, 0.75 * profit - other)
    output = [r[10] ** 0.3 * r[9] ** 0.7 + r[11] for r in rows]
    assert math.isclose(out.total_output, sum(output))
    linear = apportionment.apportioned_profit(df, linear=True).first()
    assert math.isclose(linear.total_output, sum(r[9] + r[10] + r[11] for r in rows))


def test_apportioned_profit_with_trade(spark):
    _, df = _factors(spark)
    flows = spark.createDataFrame(
        [(1, 0, 1, 1, 2.0, 0.0, 0.0), (1, 0, 1, 2, 1.0, 0.1, 0.5), (1, 0, 2, 2, 1.1, 0.0, 0.0)],
        "firm_id long, year int, producing_state int, consuming_state int, quantity double, "
        "iceberg_trade_cost double, non_iceberg_trade_cost double",
    )
    plain = apportionment.apportioned_profit(df).first()
    out = apportionment.apportioned_profit(df, flows).first()
    shipped = 2.0 * 1.2 + 0.9 * 1.4 + 1.1 * 1.4
    sales = 3.0 * 1.2 + 2.0 * 1.4
    assert math.isclose(
        out.after_tax_profit, plain.after_tax_profit - 0.01 * (shipped - sales) - 0.5
    )


def test_trade_margins_balance_without_loss(spark, rows):
    flows = spark.createDataFrame(
        [(1, 0, 1, 1, 2.0, 0.0), (1, 0, 1, 2, 4.0, 0.5), (1, 0, 2, 1, 1.0, 0.0)],
        "firm_id long, year int, producing_state int, consuming_state int, quantity double, "
        "iceberg_trade_cost double",
    )
    assert rows(apportionment.trade_margins(flows), "state", "quantity_produced",
                "quantity_consumed") == [(1, 6.0, 3.0), (2, 1.0, 2.0)]
    free = flows.withColumn("iceberg_trade_cost", F.lit(0.0))
    total = apportionment.trade_margins(free).agg(
        F.sum("quantity_produced"), F.sum("quantity_consumed")
    ).first()
    assert total[0] == total[1]


def test_pricing_residual_vanishes_at_the_solution(spark):
    # Equal rates: no excess rate, so the untaxed markup price solves the system.
    eps, cost = 5.0, 0.8
    q = (eps / (eps - 1) * cost) ** -eps
    df = spark.createDataFrame(
        [(1, 0, s, eps, cost, 0.2, q) for s in (1, 2)],
        "firm_id long, year int, state int, epsilon double, cost double, FA_tax_rate double, q double",
    )
    for r in apportionment.pricing_residual(df).collect():
        assert abs(r.residual) < 1e-12


def test_distortion_labels(spark, rows):
    df = spark.createDataFrame(
        [(1, y, s, 1.0 + 0.01 * s) for y, n in ((0, 2), (1, 1), (2, 2)) for s in range(1, n + 1)],
        "firm_id long, year int, state int, optimal_price double",
    )
    out = apportionment.distortion_table(
        df, ["1 Country", "2 Countries", "Sales Tax"], {0: "Sales Tax", 1: "1 Country"}, "High"
    )
    assert rows(out, "year", "state", "year_descr", "state_descr", "year_order") == [
        (0, 1, "Sales Tax", "High", 3), (0, 2, "Sales Tax", "Country 2", 3),
        (1, 1, "1 Country", "High", 1), (2, 1, "2 Countries", "High", 2),
        (2, 2, "2 Countries", "Country 2", 2),
    ]
    kept = apportionment.separate_accounting(df)
    assert rows(kept.where("year = 0"), "state", "optimal_price") == [(1, 1.0)]


def test_scenarios(spark, rows):
    firms = spark.createDataFrame([(1, 4.0), (2, 5.0)], "firm_id long, epsilon double")
    out = scenarios.scenario_panel(firms, ((0, 2), (1, 3)), {"cost": 100.0}, 0.25, 0.1)
    assert out.count() == 10
    assert rows(out.where("firm_id = 1"), "year", "state", "FA_tax_rate", "sales_tax_rate") == [
        (0, 1, 0.25, 0.025), (0, 2, 0.25, 0.0), (1, 1, 0.35, 0.0), (1, 2, 0.25, 0.0),
        (1, 3, 0.25, 0.0),
    ]
    assert {f.name for f in FIRM_PANEL.fields} >= {"FA_tax_rate", "sales_tax_rate"}


def test_rate_sweep_numbers_the_grid(spark, rows):
    firms = spark.createDataFrame([(1,)], "firm_id long")
    out = scenarios.rate_sweep(firms, 3, 0.0, 0.6)
    assert out.count() == 18
    assert rows(out.where("year = 6"), "state", "FA_tax_rate") == [(1, 0.6), (2, 0.3)]


def test_calibration_reproduces_revenue(spark):
    df = spark.createDataFrame([(90.0, 5 / 6, 6.0)], "revenue double, cost double, epsilon double")
    r = scenarios.kappa_calibration(df).first()
    assert math.isclose(r.price, 1.0) and math.isclose(r.kappa * r.price**-6 * r.price, 90.0)


def test_trade_costs_are_zero_at_home(spark, rows):
    panel = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "firm_id long, year int, state int")
    out = scenarios.trade_costs(panel, 0.02, 0.01)
    assert rows(out, "producing_state", "consuming_state", "iceberg_trade_cost",
                "non_iceberg_trade_cost") == [
        (1, 1, 0.0, 0.0), (1, 2, 0.02, 0.01), (2, 1, 0.02, 0.01), (2, 2, 0.0, 0.0)
    ]


def test_state_ratios(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 3.0), (1, 1, 2, 2.0), (1, 2, 1, 3.0)], "firm_id long, year int, state int, p double"
    )
    out = {r.year: r.p_ratio for r in apportionment.state_ratios(df, ["p"]).collect()}
    assert out == {1: 1.5, 2: None}
