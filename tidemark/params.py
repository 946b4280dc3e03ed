"""Every threshold of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The eleven sector names of the standard axis, in its order.
SECTORS = (
    "Basic Materials", "Communication Services", "Consumer Cyclical", "Consumer Defensive", "Energy", "Financial Services",
    "Healthcare", "Industrials", "Real Estate", "Technology", "Utilities",
)
#: Exchange zones, market indexes and liquidity floors.
ZONES = {"US": "America/New_York", "IDX": "Asia/Jakarta"}
INDEXES = {"US": "^IXIC", "IDX": "^JKSE"}
FLOORS = {"US": 20_000_000.0, "IDX": 1_000_000_000.0}
#: Lookbacks in order, with days or whole months.
LOOKBACKS = {"1w": ("days", 7), "1m": ("months", 1), "3m": ("months", 3), "6m": ("months", 6), "12m": ("months", 12)}
#: The score's dimensions and weights, in order.
DIMENSIONS = (("Tightness", 2), ("Orderliness", 2), ("Prior move", 1), ("Base length", 1), ("MA support", 1), ("Volume", 1), ("Sector", 1), ("ADR", 1))
#: Acceptance metrics with label, unit and expectation in each market.
ACCEPTANCE = (
    ("B1", "Universe size", "count", {"US": 1966.0, "IDX": 288.0}),
    ("B2", "Union-of-five-deciles gate width", "share", {"US": 0.285, "IDX": 0.285}),
    ("B3", "Distinct names across the five boards", "count", {"US": 112.0, "IDX": 88.0}),
    ("B4", "Detections per night", "count", {"US": 30.0}),
    ("B5", "Digest rows per night", "count", {"US": 9.6, "IDX": 1.2}),
    ("B6", "Share of list whose cluster-low stop > 1×ADR", "share", {"US": 0.92, "IDX": 0.92}),
    ("B7", "Share where the fitted line sets the trigger", "share", {"US": 0.0, "IDX": 0.0}),
    ("B8", "Share of clusters at k=3", "share", {"US": 0.37, "IDX": 0.37}),
    ("B9", "≥4★ share of the nightly list", "share", {"US": 0.18, "IDX": 0.18}),
    ("B10", "Sector/industry coverage", "share", {"US": 0.99, "IDX": 0.99}),
)
#: Names that a too eager instrument filter would lose.
SPOT_CHECK = ("BABA", "ARM", "SE", "PDD", "NOK", "SHEL", "JD", "VALE", "UL", "INFY", "ARGX", "SIMO")


@dataclass(frozen=True)
class Params:
    zones: dict = field(default_factory=lambda: dict(ZONES))
    close_minutes: int = 16 * 60 + 30  #: local close and the finality margin, in minutes of the day
    floors: dict = field(default_factory=lambda: dict(FLOORS))
    exit_share: float = 0.8
    window: int = 20  #: ADR, liquidity and density
    min_bars: int = 20
    density_min: int = 16
    density_recent: int = 4  #: the last bar is one of this many sessions
    top_decile: float = 0.90
    gate_lookbacks: tuple = ("1m", "3m", "6m")
    board_size: int = 30
    sorted_rows: int = 250_000  #: a session with more members is ranked by ranges of returns
    surge: float = 0.30
    low_adr: float = 0.04
    sectors: tuple = SECTORS
    short_lookback: str = "1w"
    long_lookback: str = "6m"
    delta_lookback: str = "1m"
    delta_sessions: int = 20
    rotation_min: int = 2
    industry_min: int = 10
    move_windows: tuple = (21, 42, 63, 126)
    base_max: int = 45
    base_min: int = 3
    cluster_ks: tuple = (7, 6, 5, 4, 3)
    tight: float = 1.5
    catch_up_10: float = 1.0
    catch_up_20: float = 2.0
    over_weight: float = 3.0
    slopes: int = 200
    max_slope: float = 0.5
    touch: float = 0.35
    zones_min: int = 2
    touch_gap: int = 3
    reach: float = 0.6
    max_overshoot: float = 1.0
    history: int = 80
    dryup_bars: int = 50
    rising_lag: int = 5
    detector_version: int = 1
    tight_k: int = 5
    churn_low: float = 0.30
    churn_high: float = 0.60
    short_base: int = 14
    dry: float = 0.95
    share_min: float = 0.10
    adr_min: float = 0.05
    affordable: float = 1.0
    warm_up: int = 25
    breakout: int = 20
    chart_bars: int = 200
    ema: int = 65
    resolution_floor: float = 0.99
    enumeration_floor: float = 0.90
    retention_months: int = 24
    label_slice: int = 30
    tolerance: float = 0.10
    four_star: float = 4.0


#: For the bars that are derived from the test tables: weekly, in currency-free units.
DERIVED = Params(floors={"US": 4000.0, "IDX": 4000.0}, sectors=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "UNCHARTED"), industry_min=3)
