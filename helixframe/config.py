"""Frozen policies of the mapper: one dataclass, resolved once from a mode, passed into every operator."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Policy:
    """Limits and scores of one mapping mode. Options are orthogonal: changing one leaves the others as the mode has them."""

    mode: str = "standard"
    k: int = 15
    window: int = 8
    max_stored_hits: int = 256
    cached_hits: int = 128
    segment: int = 2048
    overlap: int = 512
    probes_per_segment: int = 6
    max_probe_frequency: int = 40
    endpoint_window: int = 1000
    endpoint_probes: int = 4
    endpoint_max_frequency: int = 250
    max_total_hits: int = 8000
    min_segments: int = 2
    diagonal_tolerance: int = 2000
    max_regions: int = 20
    max_candidates: int = 20
    max_anchors: int = 512
    flank: int = 1024
    min_anchor: int = 30
    max_iter: int = 256
    match: int = 2
    mismatch: int = 4
    gap_open: int = 6
    gap_extend: int = 1
    dual_affine: bool = False
    dual_open: tuple[int, int] = (6, 24)
    dual_extend: tuple[int, int] = (2, 1)
    supplementary_bases: int = 500
    query_overlap: float = 0.20
    ref_overlap: float = 0.60
    max_supplementary: int = 4
    max_secondary: int = 0
    secondary_ratio: float = 0.80
    competitive_score: float = 0.40
    full_search_score: float = 0.0
    weak_candidate: float = 0.50
    without_placement: int = 3
    high_coverage: float = 0.90
    low_coverage: float = 0.40
    ambiguity_score: float = 0.60
    ambiguity_count: int = 4
    ambiguity_budget: int = 3
    reseed: bool = False
    reseed_intervals: int = 4
    reseed_hits: int = 2
    limited_cap: int = 50
    ambiguity_cap: int = 5
    mapq_mode: str = "mm2"
    structural_min: int = 2000
    structural_max: int = 100_000
    structural_penalty: int = 40
    snp_anchors: bool = False
    near_exact: bool = False
    near_exact_drift: int = 256
    near_exact_slack: int = 64
    near_exact_divergence: float = 0.10
    anchor_stages: bool = False
    paired_emms: bool = False
    emms_mismatch: int = 1
    emms_relock: int = 24
    rarest_first: bool = False
    overlap_flank: int = 0
    overlap_flank_min: int = 0
    dissolve_run: int = 2
    polish: int = 256
    phase_repair: bool = True
    divergent_window: int = 16
    island_depth: int = 8
    small_gap: int = 1024
    small_delta: int = 256
    medium_gap: int = 2048
    medium_delta: int = 512

    @property
    def max_dist(self) -> int:
        return max(20 * max(self.diagonal_tolerance, 0), 10_000)


_MODES = {
    "fast": {"max_total_hits": 4000, "max_regions": 8, "max_candidates": 4, "max_anchors": 256, "max_iter": 64, "dissolve_run": 0},
    "standard": {},
    "sensitive": {"max_regions": 32, "max_candidates": 32, "max_anchors": 1024, "medium_gap": 4096, "medium_delta": 1024, "limited_cap": 60, "dissolve_run": 4},
}


def policy(mode: str = "standard", **options) -> Policy:
    """The policy of a mode with single options changed; unknown modes and options are errors."""
    if mode not in _MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {', '.join(_MODES)}")
    own = replace(Policy(mode=mode), **_MODES[mode])
    if options.pop("tiered_candidates", False):
        own = replace(own, full_search_score=0.70)
    unknown = sorted(set(options) - {f.name for f in fields(Policy)})
    if unknown:
        raise ValueError(f"unknown option {unknown[0]!r}; did you mean {closest(unknown[0])!r}?")
    out = replace(own, **options)
    if out.k < 1 or out.k > 31:
        raise ValueError("k must be from 1 to 31")
    if out.max_stored_hits < 1:
        raise ValueError("max_stored_hits must be positive")
    if not 0 <= out.max_secondary <= 64:
        raise ValueError("max_secondary must be from 0 to 64")
    if out.mapq_mode not in ("mm2", "legacy"):
        raise ValueError("mapq_mode must be mm2 or legacy")
    return out


def closest(name: str) -> str:
    """The option whose name is most like a misspelt one."""
    names = [f.name for f in fields(Policy)] + ["tiered_candidates"]
    return max(names, key=lambda n: difflib.SequenceMatcher(None, name, n).ratio())


def parse_size(text: str) -> int:
    """Bytes of a size such as 768, 64M or 2GiB: K, M, G and T are powers of 1024, in either case."""
    t = text.strip().upper().removesuffix("IB").removesuffix("B")
    power = "KMGT".find(t[-1:]) + 1 if t[-1:] else 0
    number = t[:-1] if power else t
    if not number.isascii() or not number.isdigit():
        raise ValueError(f"invalid size {text!r}")
    return int(number) << (10 * power)
