"""Accepted values of a trusted record; fixtures or other deployments can rename them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrustSpec:
    value_type: str = "actual"
    period_type: str = "calendar_year"
    measurement_scope: str = "plant"
    metric: str = "gross_generation"
    normalized_unit: str = "gwh"
    validation_status: str = "passed"
    publication_status: str = "publishable"
    review_status: str = "approved"
    min_confidence: float = 0.7

    def equalities(self) -> dict[str, str]:
        return {k: v for k, v in self.__dict__.items() if k != "min_confidence"}
