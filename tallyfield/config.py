"""Settings of the reports, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Business settings. Thresholds for quality are placeholders until someone confirms them."""

    weight_column: str = "conditioned_kg"
    price_basis_column: str = "conditioned_kg"
    buyer: str | None = None
    contract_qty_to_kg: int = 1000
    near_completion_pct: int = 90
    low_achievement_pct: int = 20
    moisture_warn: int = 12
    moisture_critical: int = 15
    impurity_warn: int = 6
    impurity_critical: int = 9
    least_conversion: str = "0.75"
    most_conversion: str = "1.02"
    picking_share_pct: int = 20
    counted_statuses: tuple[str, ...] = ("ACTIVE",)
    plan_types: tuple[str, ...] = ("fyuchers", "фьючерс", "futures")
    least_confidence: float = 0.8
    client_code_length: int = 9
    total_tolerance_kg: int = 50
    total_tolerance_pct: int = 2
    time_zone: str = "Asia/Tashkent"
    refresh_minutes: int = 60

    def __post_init__(self) -> None:
        if self.refresh_minutes not in (30, 60):
            raise ValueError("refresh_minutes is 30 or 60")
        if self.weight_column not in ("conditioned_kg", "calculated_kg", "physical_kg"):
            raise ValueError(f"no such weight: {self.weight_column}")


DEFAULT = EngineConfig()
