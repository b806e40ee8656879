"""Settings of the engine, with their defaults and checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The version written in saved graphs unless another is asked for, and how the readable ones end, whatever program wrote them.
FORMAT_VERSION, READABLE = "memloom-v1", "-v1"
DAY = 86_400


@dataclass(frozen=True)
class BuildConfig:
    """How the similarity graph is built."""

    spectral_dims: int = 8
    adjacency_threshold: float = 0.2
    spectral_link_threshold: float = 0.9
    embedding_link_threshold: float = 0.5
    min_clusters: int = 2
    max_clusters: int = 8
    alpha: float = 0.8
    beta: float = 0.2
    polarity_threshold: float = 0.85

    def __post_init__(self) -> None:
        if self.spectral_dims < 1:
            raise ValueError("spectral_dims must be at least 1")
        for name in ("adjacency_threshold", "spectral_link_threshold", "embedding_link_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.min_clusters < 1:
            raise ValueError("min_clusters must be at least 1")
        if self.max_clusters < self.min_clusters:
            raise ValueError("max_clusters must not be below min_clusters")

    #: The settings a saved graph hands to later builds.
    STICKY = ("spectral_dims", "min_clusters", "max_clusters")

    def merged(self, saved: dict | None, **given) -> BuildConfig:
        """What is given wins over what the last build used, and that over the defaults."""
        sticky = {k: int(v) for k, v in (saved or {}).items() if k in self.STICKY}
        return replace(self, **{**sticky, **{k: v for k, v in given.items() if v is not None}})

    def clamp_clusters(self, wanted: int, returned: int, n: int) -> int:
        """Cluster count from the eigengap: within the limits, and no more than eigenpairs or notes allow."""
        within = min(max(wanted, self.min_clusters), self.max_clusters)
        return min(within, min(returned, max(self.min_clusters, n)))


TEMPORAL_MODES = ("exponential", "linear", "step", "buckets")


def days_to_seconds(days: float) -> int:
    return max(1, round(days * DAY))


def parse_temporal_mode(name: str) -> str:
    """The mode of a command-line name; names it does not know mean exponential."""
    return {"linear": "linear", "linearwindow": "linear", "step": "step", "buckets": "buckets"}.get(name.strip().lower(), "exponential")


@dataclass(frozen=True)
class TemporalConfig:
    """How age weighs in ranking."""

    enabled: bool = True
    weight: float = 0.20
    mode: str = "exponential"
    half_life: int | None = 14 * DAY
    window: int | None = None
    magnitude: float | None = None
    buckets: Sequence[tuple[int, float]] | None = None
    now: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in TEMPORAL_MODES:
            raise ValueError(f"unknown temporal mode {self.mode}")


SPLIT_MODES = ("off", "auto", "strict", "ast")


@dataclass(frozen=True)
class SplitConfig:
    """How commit messages are cut into segments."""

    mode: str = "auto"
    max_segments: int = 6
    min_confidence: float = 0.75

    def __post_init__(self) -> None:
        mode = self.mode.strip().lower()
        if mode not in SPLIT_MODES:
            raise ValueError(f"unknown split mode {self.mode}")
        object.__setattr__(self, "mode", mode)
        object.__setattr__(self, "max_segments", max(1, self.max_segments))
        object.__setattr__(self, "min_confidence", min(1.0, max(0.0, self.min_confidence)))


# The line patterns of the one known preset.
PRESETS = {"git-noise": [r"^Co-authored-by:", r"^Signed-off-by:", r"^Reviewed-by:", r"^Change-Id:", r"^See merge request"]}


@dataclass(frozen=True)
class FilterConfig:
    """Which lines of commit messages are dropped."""

    preset: str | None = None
    drop: Sequence[str] = field(default_factory=tuple)
    ignore_case: bool = False

    @property
    def patterns(self) -> list[str]:
        import re

        if self.preset is not None and self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset}")
        found = [*PRESETS.get(self.preset, []), *self.drop]
        for p in found:
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"bad pattern {p}: {e}") from e
        return [f"(?i){p}" if self.ignore_case else p for p in found]

    def matches(self, line: Column) -> Column:
        out = F.lit(False)
        for p in self.patterns:
            out = out | line.rlike(p)
        return out


def clamp_top_k(top_k: int | None, default: int, most: int) -> int:
    return min(max(default if top_k is None else top_k, 1), most)
