"""Scalar expressions.

Division by zero and the logarithm of zero give NULL, so that such rows leave every average and
regression, as undefined values do in the statistics they feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(_col(a), _col(b))


def safe_ln(x: Column | str) -> Column:
    """Natural logarithm, NULL at zero and below."""
    return F.ln(_col(x))


def year_of(yyyymmdd: Column | str) -> Column:
    """Year of a yyyymmdd integer."""
    return F.floor(_col(yyyymmdd) / 10000).cast("int")


def quarter_of(yyyymmdd: Column | str) -> Column:
    """Quarter of a yyyymmdd integer, NULL when the month is no month.

    Integer arithmetic: no per-row date parsing in the widest scan of the library.
    """
    month = F.floor(_col(yyyymmdd) / 100).cast("int") % 100
    return F.when(month.between(1, 12), F.ceil(month / 3).cast("int"))


def year_quarter(year: Column | str = "year", quarter: Column | str = "quarter") -> Column:
    """Quarters as one running integer."""
    return _col(year) * 4 + _col(quarter) - 1


def week_revenue(price: Column | str, prmult: Column | str, units: Column | str) -> Column:
    """Revenue of a week: the price is for `prmult` units."""
    return safe_div(price, prmult) * _col(units)


def unit_price(revenue: Column | str = "revenue", quantity: Column | str = "quantity",
               digits: int | None = None) -> Column:
    """Revenue per unit, rounded half up when digits are given."""
    price = safe_div(revenue, quantity)
    return price if digits is None else F.round(price, digits)


def post(cutoff: int, year: Column | str = "year") -> Column:
    """1 from the cutoff year on, else 0."""
    return (_col(year) >= cutoff).cast("int")


def demand(price: Column | str, kappa: Column | str = "kappa",
           epsilon: Column | str = "epsilon") -> Column:
    """Quantity demanded with constant elasticity epsilon."""
    return _col(kappa) * F.pow(_col(price), -_col(epsilon))


def inverse_demand(quantity: Column | str, kappa: Column | str = "kappa",
                   epsilon: Column | str = "epsilon") -> Column:
    """Price at which the quantity is demanded."""
    return F.pow(_col(quantity) / _col(kappa), -1 / _col(epsilon))


def markup_price(cost: Column | str = "cost", epsilon: Column | str = "epsilon") -> Column:
    """Profit-maximising price without taxes."""
    return _col(epsilon) / (_col(epsilon) - 1) * _col(cost)
