"""Prices, tax bills and profits of multi-state firms under different tax rules.

Windows here are per firm and year: one row per state. Totals over a whole year, whose rows have no
such bound, are aggregated and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.groups import value_at
from aisleframe.functions.scalars import demand, markup_price, safe_div
from aisleframe.operators.reshape import relabel_union

FIRM_YEAR = ("firm_id", "year")
REGIMES = ("perceived_sales_tax", "naive", "optimal")


def counterfactual_prices(panel: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Price, quantity, revenue, profit, sales share and tax bill of each regime.

    perceived_sales_tax passes the rate on as if it were a sales tax, naive ignores it, optimal takes
    the given optimal_price, optimal_quantity_consumed and optimal_state_revenue; sales_tax is a true
    sales tax with a producer and a consumer price.
    """
    base = markup_price()
    gross = 1 + F.col("tax_rate") / F.col("epsilon")
    prices = {
        "perceived_sales_tax_price": base * gross,
        "naive_price": base,
        "sales_tax_producer_price": base,
        "sales_tax_consumer_price": base * gross,
    }
    out = panel.withColumns({"perceived_sales_tax_rate": gross, **prices})
    out = out.withColumns({
        **{f"{r}_quantity": demand(f"{r}_price") for r in REGIMES if r != "optimal"},
        "optimal_quantity": F.col("optimal_quantity_consumed"),
        "sales_tax_quantity": demand("sales_tax_consumer_price"),
    })
    margin = {
        f"{r}_state_profits": F.col(f"{r}_quantity") * (F.col(f"{r}_price") - F.col("cost"))
        for r in REGIMES
    }
    out = out.withColumns({
        **margin,
        **{f"{r}_revenue": F.col(f"{r}_price") * F.col(f"{r}_quantity") for r in REGIMES
           if r != "optimal"},
        "optimal_revenue": F.col("optimal_state_revenue"),
        "sales_tax_profits": F.col("sales_tax_quantity")
        * (F.col("sales_tax_producer_price") - F.col("cost")),
    })
    return _tax_bills(out, by)


def _tax_bills(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sales share of the group and the tax it draws on the group's profit."""
    totals = df.groupBy(*by).agg(*[
        F.sum(f"{r}_{what}").alias(f"_{r}_{what}")
        for r in REGIMES for what in ("revenue", "state_profits")
    ])
    joined = df.join(totals, list(by))
    shares = joined.withColumns({
        f"{r}_sales_share": safe_div(f"{r}_revenue", f"_{r}_revenue") for r in REGIMES
    })
    bills = shares.withColumns({
        f"{r}_state_tax_bill": F.col(f"{r}_sales_share") * F.col("tax_rate")
        * F.col(f"_{r}_state_profits")
        for r in REGIMES
    })
    return bills.drop(*[c for c in totals.columns if c.startswith("_")])


def profit_comparison(counterfactuals: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """After-tax profit totals of the three regimes."""
    def after_tax(regime: str) -> Column:
        return F.sum(f"{regime}_state_profits") - F.sum(f"{regime}_state_tax_bill")

    return counterfactuals.groupBy(*by).agg(
        after_tax("naive").alias("total_post_tax_naive_profits"),
        after_tax("optimal").alias("total_post_tax_optimal_profits"),
        after_tax("perceived_sales_tax").alias("total_sales_tax_profits"),
    )


def markup_table(solved: DataFrame) -> DataFrame:
    """Firm totals and the markup over cost computed two ways: from firm totals, and as the
    sales-weighted mean of state markups.
    """
    firm = Window.partitionBy(*FIRM_YEAR)
    unit_cost = safe_div("optimal_state_cost", "optimal_quantity_produced")
    quantity = F.col("optimal_quantity_consumed")
    out = solved.withColumns({
        "total_firm_revenue": F.sum("optimal_state_revenue").over(firm),
        "total_firm_cost": F.sum("optimal_state_cost").over(firm),
        "total_firm_sales_quantity": F.sum(quantity).over(firm),
        "state_markup": safe_div(F.col("optimal_price") - unit_cost, unit_cost),
    })
    return out.withColumns({
        "firm_markup": safe_div(
            F.col("total_firm_revenue") - F.col("total_firm_cost"), "total_firm_cost"
        ),
        "firm_weighted_markup": F.sum(
            F.col("state_markup") * safe_div(quantity, "total_firm_sales_quantity")
        ).over(firm),
    })


def distortion_table(solved: DataFrame, levels: Sequence[str], special: dict[int, str],
                     raising_label: str, raising_state: int = 1) -> DataFrame:
    """Price distortions with the labels and the order the charts use.

    special maps a year to its own label; other years are labelled by their number of states. A label
    outside the levels has no order.
    """
    states = F.count(F.lit(1)).over(Window.partitionBy(*FIRM_YEAR))
    label = F.concat(F.col("n_states").cast("string"), F.lit(" Countries"))
    for year, text in special.items():
        label = F.when(F.col("year") == year, F.lit(text)).otherwise(label)
    out = solved.withColumn("n_states", states).withColumns({
        "year_descr": label,
        "state_descr": F.when(F.col("state") == raising_state, F.lit(raising_label)).otherwise(
            F.concat(F.lit("Country "), F.col("state").cast("string"))
        ),
        "price_to_plot": F.col("optimal_price") - 1,
    })
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("year_descr"))
    return out.withColumn("year_order", F.nullif(position, F.lit(0)))


def sweep_distortion(solved: DataFrame, state: int = 1, rate: str = "FA_tax_rate") -> DataFrame:
    """Price distortions along a rate sweep: the rate of the given state on every row, and a copy of
    that state's rows as separate accounting, which distorts nothing.
    """
    own = F.col("state") == state
    out = solved.select(
        "firm_id", "state", "year",
        F.concat(F.lit("Country "), F.col("state").cast("string")).alias("state_descr"),
        (F.col("optimal_price") - 1).alias("price_to_plot"),
        value_at(own, rate, FIRM_YEAR).alias("swept_rate"),
    )
    return relabel_union(out, own, {
        "state_descr": F.lit("Separate Accounting"), "price_to_plot": F.lit(0.0),
    })


def separate_accounting(solved: DataFrame, year: int = 0, state: int = 1) -> DataFrame:
    """Replace the comparison year by separate accounting: one state, price one."""
    kept = solved.where((F.col("year") != year) | (F.col("state") == state))
    return kept.withColumn(
        "optimal_price", F.when(F.col("year") == year, 1.0).otherwise(F.col("optimal_price"))
    )


def wage() -> Column:
    """Given wage, or the wage at which the labour supply curve yields l when rho is finite."""
    supply = F.pow(F.col("l") / F.col("Lbar"), 1 / F.col("rho"))
    return F.when(F.col("rho") == float("inf"), F.col("wage")).otherwise(supply)


def production(linear: bool = False) -> Column:
    """Output from labour, capital and materials."""
    if linear:
        return F.col("l") + F.col("k") + F.col("m")
    share = F.col("alpha")
    return F.col("A") * F.pow(F.col("k"), share) * F.pow(F.col("l"), 1 - share) + F.col("m")


def evaluate_states(panel: DataFrame, linear: bool = False) -> DataFrame:
    """Wage, revenue, factor cost, output and payroll of each state at given p, q, l, k, m."""
    out = panel.withColumn("wage_paid", wage())
    return out.withColumns({
        "payroll": F.col("wage_paid") * F.col("l"),
        "property": F.col("rental_rate") * F.col("k"),
        "sales": F.col("p") * F.col("q"),
        "output": production(linear),
    }).withColumn(
        "factor_cost", F.col("payroll") + F.col("property") + F.col("cost") * F.col("m")
    )


def apportioned_profit(panel: DataFrame, trade: DataFrame | None = None,
                       linear: bool = False) -> DataFrame:
    """Tax rate and after-tax profit of each firm-year under three-factor apportionment, and under
    equal shares (naive).

    A state taxes its rate times its weighted share of the firm's sales, payroll and property.
    Without a trade table a state's own profit is its sales less its factor cost. With one, a state's
    revenue is what it ships net of iceberg loss at the price of the consuming state, and trade costs
    per unit are subtracted.
    """
    firm = Window.partitionBy(*FIRM_YEAR)
    states = evaluate_states(panel, linear)
    if trade is None:
        states = states.withColumn("shipped_revenue", F.col("sales")).withColumn(
            "trade_cost", F.lit(0.0)
        )
    else:
        prices = panel.select(*FIRM_YEAR, F.col("state").alias("consuming_state"), "p")
        shipped = trade.join(prices, [*FIRM_YEAR, "consuming_state"]).groupBy(
            *FIRM_YEAR, F.col("producing_state").alias("state")
        ).agg(
            F.sum((1 - F.col("iceberg_trade_cost")) * F.col("quantity") * F.col("p"))
            .alias("shipped_revenue"),
            F.sum(F.col("non_iceberg_trade_cost") * F.col("quantity")).alias("trade_cost"),
        )
        states = states.join(shipped, [*FIRM_YEAR, "state"], "left").fillna(
            0.0, ["shipped_revenue", "trade_cost"]
        )

    def share(base: str) -> Column:
        return F.coalesce(safe_div(base, F.sum(base).over(firm)), F.lit(0.0))

    taxed = states.withColumn(
        "state_rate",
        F.col("FA_tax_rate") * (
            F.col("sales_weight") * share("sales")
            + F.col("payroll_weight") * share("payroll")
            + F.col("property_weight") * share("property")
        ),
    )
    profit = F.sum("sales") - F.sum("factor_cost")
    other = (
        F.sum(F.col("separate_acct_tax_rate") * (F.col("shipped_revenue") - F.col("factor_cost")))
        + F.sum(F.col("sales_tax_rate") * F.col("sales"))
        + F.sum(F.col("payroll_tax_rate") * F.col("payroll"))
        + F.sum("trade_cost")
    )
    return taxed.groupBy(*FIRM_YEAR).agg(
        F.sum("state_rate").alias("apportioned_rate"),
        F.avg("FA_tax_rate").alias("naive_rate"),
        F.sum("factor_cost").alias("total_cost"),
        F.sum("output").alias("total_output"),
        profit.alias("pre_tax_profit"),
        ((1 - F.sum("state_rate")) * profit - other).alias("after_tax_profit"),
        ((1 - F.avg("FA_tax_rate")) * profit - other).alias("after_tax_profit_naive"),
    )


def trade_margins(trade: DataFrame) -> DataFrame:
    """Quantity produced and consumed (net of iceberg loss) by firm, year and state."""
    flow = F.col("quantity")
    # One pass: each flow counts once for its producer and once for its consumer.
    sides = F.array(
        F.struct(F.col("producing_state").alias("state"), flow.alias("produced"),
                 F.lit(0.0).alias("consumed")),
        F.struct(F.col("consuming_state").alias("state"), F.lit(0.0).alias("produced"),
                 ((1 - F.col("iceberg_trade_cost")) * flow).alias("consumed")),
    )
    return trade.select(*FIRM_YEAR, F.explode(sides).alias("_s")).groupBy(
        *FIRM_YEAR, F.col("_s.state").alias("state")
    ).agg(
        F.sum("_s.produced").alias("quantity_produced"),
        F.sum("_s.consumed").alias("quantity_consumed"),
    )


def state_ratios(df: DataFrame, columns: Sequence[str], first: int = 1, second: int = 2,
                 keys: Sequence[str] = FIRM_YEAR) -> DataFrame:
    """Ratio of state `first` to state `second` of each column, by sweep point."""
    def at(state: int, c: str) -> Column:
        return F.max(F.when(F.col("state") == state, F.col(c)))

    return df.groupBy(*keys).agg(*[
        safe_div(at(first, c), at(second, c)).alias(f"{c}_ratio") for c in columns
    ])


def pricing_residual(panel: DataFrame) -> DataFrame:
    """How far given quantities are from solving the comparison pricing system, by state."""
    firm = Window.partitionBy(*FIRM_YEAR)
    mean_rate = safe_div(F.sum(F.col("FA_tax_rate") * F.col("q")).over(firm), F.sum("q").over(firm))
    excess = safe_div(F.col("FA_tax_rate") - F.col("mean_rate"), 1 - F.col("mean_rate"))
    eps = F.col("epsilon")
    implied = safe_div(eps, eps - F.col("excess_rate")) * markup_price()
    return panel.withColumn("mean_rate", mean_rate).withColumn("excess_rate", excess).withColumn(
        "residual", F.pow(F.col("q"), -1 / eps) - implied
    )
