"""Settings of the pipelines, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass, field

from intervane.errors import ArgumentError


@dataclass(frozen=True)
class PrepConfig:
    """Selection of dense regions and their division into work packages."""

    bandwidth: float = 200.0
    threshold: float = 2.0
    selection_padding: int = 10_000
    region_padding: int = 5_000
    interval_overlap: int = 10_000
    max_locs: int = 10_000_000
    max_cuts: int = 15_000_000
    memory_target: float = 20.0
    c1_cov: str = "Matern32(500)"
    c2_cov: str = "Matern32(2000)"
    sparsity_threshold: float = 1e-8
    seed: int = 242567
    excluded_sequences: tuple[str, ...] = ("chrM", "chrUn", "chrEBV")
    barcode_pattern: str | None = None
    omit_postfix: bool = False
    keep_duplicates: bool = False

    def __post_init__(self):
        if min(self.bandwidth, self.selection_padding, self.interval_overlap, self.max_locs, self.max_cuts) <= 0:
            raise ArgumentError("sizes must be positive")


@dataclass(frozen=True)
class PeakConfig:
    """Peak calling on two tracks."""

    min_size: dict[str, int] = field(default_factory=lambda: {"c1": 100, "c2": 400})
    smooth: dict[str, int] = field(default_factory=lambda: {"c1": 0, "c2": 2000})
    fraction_in_peaks: float = 0.5
    fraction_overlap: float = 0.5
    span: int = 10
    bandwidth: float = 200.0

    def __post_init__(self):
        if not 0 < self.fraction_in_peaks < 1:
            raise ArgumentError("fraction_in_peaks must lie between 0 and 1")
