"""Every open parameter of the panel rules in one place; results name the values that they used."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    #: The dictionary gives no tolerance, sign conventions, tie-break or log base: these are ours.
    identity_tolerance: float = 1.0
    pl_tolerance: float = 1.0
    home_country: str = "India"
    match_score_min: float = 0.8
    max_depth: int = 30
    outlier_mads: float = 5.0
