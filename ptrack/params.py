"""Processing parameters, saved as JSON next to every result table."""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

# Default sensor size in pixels (x, y).
SENSOR_X = 1280
SENSOR_Y = 720
SENSOR = (SENSOR_X, SENSOR_Y)


@dataclass(frozen=True)
class Params:
    # preprocessing
    dt: float = 2000.0                 # slice length in µs
    only_positive: bool = True
    # detection
    method: str = "pixelwise"          # pixelwise | dbscan | kdtree | pseudoframe
    min_pixels: int = 5
    overlap: float = 0.4
    structure_size: int = 1
    epsilon: float = 4.0
    min_pts: int = 7
    threshold: float = 7.5
    area: int = 5
    filter_size: int = 3
    sensor_x: int = SENSOR_X           # size of pseudo-frames
    sensor_y: int = SENSOR_Y
    multirun: bool = False
    multi_factor: int = 2
    test_mode: bool = False            # one slice, one run, no filters
    compat_offbyone: bool = False      # first label of a slice never spawns
    compat_second_run: bool = False    # second run ends after slice count // factor
    compat_repair: bool = False        # repair links applied once, in target order
    slice_stride: int = 0              # slice numbers of one recording; 0: there is one only
    # post filters
    spawn_min_events: int = 5
    min_steps: int = 3
    min_events: int = 20
    min_centers_events: int = 40
    repair_dist: float = 5.0
    repair_center_dist: float = 4.0
    # tracking
    tracking: str = "kalman"           # kalman | bspline | hybrid_xk_us | hybrid_xk_uks | hybrid_xks_uks
    p0: float = 1e8
    q: tuple = ((2e-6, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 4e5))
    r: float = 1.0
    resol: float = 1.0
    target_rms: float = 3.0
    correction: bool = False
    beta: float = 0.8
    # validation
    quality_filter: bool = False
    quality_threshold: float = 2.0
    quality_quantile: float = 0.95
    w_angle: float = 1.0
    w_velo: float = 1.0
    w_path: float = 1.0
    neighborhood_filter: bool = False
    nb_dt_factor: float = 2.0
    nb_radius: float = 30.0
    nb_mad_factor: float = 30.0
    nb_angle_factor: float = 20.0
    nb_min_neighbors: int = 3
    # physical layout: change only how the work is cut, never the results
    block_slices: int = 8
    warmup_slices: int = 2
    chunk_rows: int = 8192

    @property
    def step(self) -> float:
        """Distance of track points in µs."""
        return self.dt / self.resol

    def first(self, k):
        """Is k (a number or a column) the first slice of a recording?"""
        return k % self.slice_stride == 0 if self.slice_stride else k == 0

    @property
    def structure(self) -> int:
        n = max(1, int(self.structure_size))
        if n % 2 == 0:
            raise ValueError("structure_size must be odd")
        return n

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Params":
        known = {f.name for f in fields(cls)}
        d = {k: v for k, v in json.loads(text).items() if k in known}
        if "q" in d:
            d["q"] = tuple(tuple(r) for r in d["q"])
        return cls(**d)
