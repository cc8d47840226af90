"""Parameters of a study. The defaults are those of the scanner-data study."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Study:
    """Focal state, comparison states, window, base quarter and treatment year."""

    focal: int = 6
    others: tuple[int, ...] = (12, 48, 53, 41)
    window: tuple[int, int] = (2009, 2013)
    base: tuple[int, int] = (2010, 4)
    cutoff: int = 2011
    zero_tax_year: int = 2011
    presence: tuple[int, int] = (2, 5)
    price_digits: int = 2
    bins: int = 5
    placebos: tuple[int, int] | None = None
