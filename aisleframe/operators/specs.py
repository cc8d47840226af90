"""Catalogue of difference-in-differences specifications."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class DidSpec:
    """One regression: rows of `sample`, treatment `x`, absorbed cells `fe`, treated from `cutoff` on.

    `sample` and `x` are SQL expressions over the panel.
    """

    name: str
    sample: str
    x: str
    fe: tuple[str, ...]
    cutoff: int


def samples(focal: int, presence: tuple[int, int]) -> dict[str, str]:
    """Row conditions the specifications draw on."""
    low, high = presence
    away = f"fips_state_code <> {focal}"
    few = f"presence_count BETWEEN {low} AND {high}"
    multi = "in_focal = 1 AND only_in_focal = 0"
    return {
        "focal": f"fips_state_code = {focal}",
        "away": away,
        "away_zero": f"{away} AND zerotax",
        "away_few": f"{away} AND {few}",
        "away_zero_few": f"{away} AND zerotax AND {few}",
        "multi": multi,
        "multi_few": f"{multi} AND presence_count <= {high}",
    }


def flag_specs(cutoff: int, item: Sequence[str] = (), focal: int = 6,
               presence: tuple[int, int] = (2, 5)) -> list[DidSpec]:
    """r1 to r7: treatment is a flag; `item` are the product keys inside the absorbed cells."""
    rows = samples(focal, presence)
    time = (*item, "yearqtr")
    chain = ("parent_code", *item, "yearqtr")
    in_state = f"fips_state_code = {focal}"
    return [
        DidSpec("r1", rows["focal"], "only_in_focal", time, cutoff),
        DidSpec("r2", rows["away"], "in_focal", time, cutoff),
        DidSpec("r3", rows["away_zero"], "in_focal", time, cutoff),
        DidSpec("r4", rows["away_few"], "in_focal", time, cutoff),
        DidSpec("r5", rows["away_zero_few"], "in_focal", time, cutoff),
        DidSpec("r6", rows["multi"], in_state, chain, cutoff),
        DidSpec("r7", rows["multi_few"], in_state, chain, cutoff),
    ]


def share_specs(names: Sequence[str], cutoff: int, item: Sequence[str] = (), focal: int = 6,
                presence: tuple[int, int] = (2, 5)) -> list[DidSpec]:
    """Treatment is the chain's mean focal-state share before the cutoff."""
    rows = samples(focal, presence)
    return [
        DidSpec(name, rows[sample], "focal_share_pre", (*item, "yearqtr"), cutoff)
        for name, sample in zip(names, ("away", "away_zero", "away_few"), strict=True)
    ]


def category_specs(cutoff: int, item: Sequence[str] = (), **kw) -> list[DidSpec]:
    """The ten regressions of one category; `item` is ("extras_group",) at product level."""
    return flag_specs(cutoff, item, **kw) + share_specs(("r2a", "r3a", "r4a"), cutoff, item, **kw)


def pooled_specs(cutoff: int, placebos: tuple[int, int] | None = None, item: Sequence[str] = ("group",),
                 focal: int = 6, presence: tuple[int, int] = (2, 5)) -> list[DidSpec]:
    """The thirteen regressions over all categories; r12 and r13 repeat r11 at placebo cutoffs."""
    before, after = placebos or (cutoff - 1, cutoff + 2)
    kw = {"item": item, "focal": focal, "presence": presence}
    rows = samples(focal, presence)
    return (
        flag_specs(cutoff, **kw)
        + share_specs(("r8", "r9", "r10"), cutoff, **kw)
        + [
            DidSpec(name, rows["away_zero_few"], "focal_share_pre", (*item, "yearqtr"), cut)
            for name, cut in (("r11", cutoff), ("r12", before), ("r13", after))
        ]
    )


def single_category_specs(cutoff: int, focal: int = 6) -> list[DidSpec]:
    """The three regressions of the one-category study: the third absorbs quarters only."""
    rows = samples(focal, (2, 5))
    return [
        *flag_specs(cutoff, focal=focal)[:2],
        DidSpec("r3", rows["multi"], f"fips_state_code = {focal}", ("yearqtr",), cutoff),
    ]
