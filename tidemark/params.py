"""Every window, threshold and rate used by the operators, with its default."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Params:
    # staging
    burst_seconds: int = 5
    # observation period
    left_censor_days: int = 7
    right_censor_days: int = 14
    # snapshot grid and the windows around each snapshot
    grid_lead_days: int = 28
    grid_trail_days: int = 28
    grid_step_days: int = 14
    # snapshot dates of one's own, in any distance; those inside lead and trail replace the grid
    snapshot_days: tuple[date, ...] = ()
    activity_days: int = 28
    purchase_windows: tuple[int, ...] = (7, 14, 28)
    label_days: tuple[int, ...] = (14, 28)
    category_min_customers: int = 100
    # cohorts
    retention_days: tuple[int, ...] = (7, 14, 28)
    # lifecycle and segments
    recent_days: int = 14
    declining_days: int = 28
    at_risk_days: int = 60
    return_gap_days: int = 28
    fast_removal_seconds: int = 21_600
    high_intent_visits: int = 10
    # profiling
    recent_buyer_days: int = 14
    top_clients: int = 5
    top_items: int = 10
    # modelling: number of grid dates in train / validation / test
    split_sizes: tuple[int, int, int] = (6, 1, 2)
    contact_rates: tuple[int, ...] = (5, 10, 20, 30)
    metric_rates: tuple[int, ...] = (5, 10, 20)
    # experiment: (band, from %, to %) counted from the highest score
    score_bands: tuple[tuple[str, float, float], ...] = (
        ("top_10", 0.0, 10.0),
        ("10_30", 10.0, 30.0),
        ("30_50", 30.0, 50.0),
    )
    seed: int = 42
