"""Settings of the router: weights of the search, widths of corridors, rules of simplification."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .functions.grid import Grid

#: The distances off a lane, in nautical miles, at which a bypass is tried.
OFFSETS_NM = (5, 10, 15, 20, 30, 40, 50)
#: Those at which a bypass of two waypoints is tried.
PAIR_OFFSETS_NM = (5, 10, 15, 20, 30)


@dataclass(frozen=True)
class Settings:
    """With the values that the configuration file ships."""

    #: "auto": by distance; "coarse_to_fine": leg by leg for all; "corridor": never leg by leg first.
    algorithm: str = "auto"
    coarse_threshold_nm: float = 100.0
    coarse_scale: int = 8
    heuristic: float = 1.25
    width_nm: float = 10.0
    width_long_nm: float = 10.0
    long_route_nm: float = 1500.0
    draft_m: float = 10.0
    safety_margin_m: float = 0.0
    turn_weight: float = 0.5
    wrong_way: float = 1000.0
    alignment: float = 50.0
    off_lane: float = 0.0
    lane_crossing: float = 0.0
    zone_crossing: float = 1000.0
    boundary_crossing: float = 100.0
    near_radius: int = 1
    max_deviation: float = 90.0
    snap_nm: float = 1.0
    snap: bool = True
    land_weight: float = 5.0
    land_reach: float = 6.0
    depth_weight: float = 5.0
    max_skip: int = 50
    max_simplify_nm: float = 100.0
    least_land_nm: float = 1.0
    offshore_nm: float = 12.0
    bypass_offsets_nm: tuple[float, ...] = OFFSETS_NM
    #: Cells up to which the layers' distance to land is known; by default as far as any rule looks (`reach`).
    dist_reach: float | None = None

    def reach(self, grid: Grid) -> int:
        """Cells up to which the rules ask for the distance to land on this grid."""
        return math.ceil(max(self.offshore_nm / grid.cell_nm - 1e-9, self.land_reach, self.least_land_nm / grid.cell_nm))

    def snap_cells(self, grid: Grid) -> int:
        return max(1, round(self.snap_nm / grid.cell_nm))

    def least_land(self, grid: Grid) -> int:
        return max(2, int(self.least_land_nm / grid.cell_nm))

    def pruning(self) -> float:
        """The weight of the estimate where a coarse path leads: small blocks prune harder."""
        return max(self.heuristic, 1.5) if self.coarse_scale <= 8 else self.heuristic
