"""Parameters of the analytics, as frozen dataclasses.

Nothing in an operator is hardcoded; every default lives here and can be replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: physical and product constants that results depend on ----

SCIENCE = (
    "temperature",
    "salinity",
    "density",
    "oxygen_concentration",
    "chlorophyll",
    "backscatter_700",
    "cdom",
)

CHANNEL_PRECEDENCE = (
    "temperature",
    "salinity",
    "density",
    "chlorophyll",
    "backscatter_700",
    "cdom",
    "oxygen_concentration",
)

GROSS_RANGES = {
    "temperature": (-2.0, 30.0),
    "salinity": (2.0, 42.0),
    "density": (1000.0, 1040.0),
    "oxygen_concentration": (0.0, 600.0),
    "chlorophyll": (-2.0, 60.0),
    "backscatter_700": (-0.001, 0.05),
    "cdom": (-5.0, 100.0),
    "depth": (-1.0, 1200.0),
}

COLUMN_ALIASES = {
    "lon": ("lon", "longitude", "long", "lng", "x", "lon_dec", "decimallongitude"),
    "lat": ("lat", "latitude", "y", "lat_dec", "decimallatitude"),
    "depth": ("depth", "z", "depth_m", "z_pos"),
}

SITE_PREFIXES = ("barkleycanyon", "folgerpassage", "barkley", "folger")

# ---- end of fixed values ----


@dataclass(frozen=True)
class Box:
    """Inclusive longitude / latitude box."""

    west: float = -126.80
    east: float = -124.50
    south: float = 47.85
    north: float = 49.36


STUDY_BOX = Box()
SOUND_BOX = Box(-125.55, -124.95, 48.72, 49.05)


@dataclass(frozen=True)
class Completeness:
    min_hours: int = 18
    min_days: int = 15
    drop_partial_end: bool = True


SATELLITE = Completeness(min_hours=1, min_days=3)


@dataclass(frozen=True)
class Thresholds:
    percentiles: tuple = (90, 95, 99)


@dataclass(frozen=True)
class YeardayConfig:
    window_days: int = 7
    min_years: int = 3
    smooth_days: int = 5
    percentiles: tuple = (5, 10, 25, 50, 75, 90, 95)
    good_flags: tuple = (1, 2, 7)


@dataclass(frozen=True)
class ScreenConfig:
    """Moored-buoy screening chain."""

    low: float = 2.0
    high: float = 25.0
    half_window_hours: float = 6.5
    floor: float = 1.5
    sds: float = 5.0
    min_neighbours: int = 5
    mad_scale: float = 1.4826
    window_days: int = 7


@dataclass(frozen=True)
class SeriesConfig:
    stride_days: int = 7
    tail_days: int = 7
    break_days: int = 21
    gap_days: float = 7.0


@dataclass(frozen=True)
class Recency:
    live_days: float = 14.0
    discovery_days: float = 30.0
    active_days: float = 1.0
    max_hold_hours: float = 8.0
    min_points: int = 2


@dataclass(frozen=True)
class HitTolerance:
    track_deg: float = 0.05
    site_deg: float = 0.03


@dataclass(frozen=True)
class GridConfig:
    decimals: int = 3
    newest: int = 7
    mask_epsilon: float = 1e-3
    color_low: float = 10.0
    color_high: float = 20.0
    km_per_lat: float = 110.57
    km_per_lon: float = 111.32


@dataclass(frozen=True)
class ScaleConfig:
    """How long sequences are cut so that no key is ever one task.

    A window partition is a span of time of one key. The span is the widest of
    ``chunk_widths`` (seconds) in which no key has more than ``chunk_rows`` rows, so
    partitions stop growing when rows become dense; ``screen_widths`` are those of the
    rolling screen, which copies a frame's rows at each edge.
    """

    chunk_rows: int = 500_000
    chunk_widths: tuple[int, ...] = (86_400, 3_600, 60, 1)
    screen_widths: tuple[int, ...] = (168 * 3_600, 24 * 3_600)
    #: rows of several values that a cell of the quantiles may hold
    quantile_rows: int = 250_000


DEFAULT_SCALE = ScaleConfig()
