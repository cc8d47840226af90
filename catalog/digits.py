"""Decimals that both sides of the comparison keep: sums differ in their last bits by order.

Many values lie exactly half-way between two roundings (cents over 32 pieces), and their last bit would
decide. The boundary is therefore moved off the half: floor(x * 10^d + EDGE) / 10^d on both sides.
"""

from __future__ import annotations

EDGE = 0.4877

MONEY = (
    "revenue", "quantity", "total_revenue", "gross_revenue", "spending", "tot_sales", "revenue_only",
    "revenue_not_only", "revenue_there_exposed", "revenue_there_other", "total_firm_revenue",
    "total_firm_cost", "total_firm_sales_quantity", "optimal_quantity_consumed",
    "total_post_tax_naive_profits", "total_post_tax_optimal_profits", "total_sales_tax_profits",
    "total_cost", "total_output", "pre_tax_profit", "after_tax_profit", "after_tax_profit_naive",
    "quantity_produced", "quantity_consumed", "sales_tax_quantity", "sales_tax_profits",
) + tuple(
    f"{r}_{what}" for r in ("perceived_sales_tax", "naive", "optimal")
    for what in ("quantity", "revenue", "state_profits", "state_tax_bill")
)

DIGITS = dict.fromkeys(MONEY, 2) | {"kappa": 3}


def digits_of(column: str) -> int:
    """Decimals kept of a column: two for money and goods, six for prices, rates and shares."""
    return DIGITS.get(column, 6)
