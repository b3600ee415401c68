"""Run parameters.

One frozen ``Config`` replaces the notebook globals of the original workflow.
It is validated on construction, so a bad run stops before Spark starts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    name: str = "career"
    # citing papers from this year on count (no upper bound)
    min_cite_year: int = 1996
    # lower bound only for the paper counts (np, npc, np_d)
    min_year: int = 1960
    # authored papers up to this year count
    max_year: int = 2019
    core_types: tuple[str, ...] = ("ar", "cp", "re")
    min_core_papers: int = 5
    min_papers: int = 2
    min_classified: int = 1
    # author ids <= floor are placeholders; None keeps every non-null id
    auid_floor: int | None = 4
    top_n: int = 100_000
    top_frac: float = 0.02
    wide_frac: float = 0.1  # the wider band of the drop-out statistics
    percentiles: tuple[float, ...] = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
    ratio_percentiles: tuple[float, ...] = (0.95, 0.99)
    # "2019": per-paper subjects, dominant last-year affiliation, upper-bound cut-offs
    # "2017": journal subjects, last-paper affiliation, lower-bound cut-offs
    edition: str = "2019"

    def __post_init__(self):
        if self.edition not in ("2017", "2019"):
            raise ValueError(f"edition must be '2017' or '2019', not {self.edition!r}")
        if not self.min_year <= self.max_year:
            raise ValueError("min_year must not exceed max_year")
        if self.min_cite_year < self.min_year:
            raise ValueError("min_cite_year must not precede min_year")
        if self.min_core_papers < 0 or self.min_papers < 0 or self.min_classified < 1:
            raise ValueError("paper thresholds must be non-negative, min_classified >= 1")
        if not 0 < self.top_frac <= self.wide_frac <= 1:
            raise ValueError("top_frac must be in (0, 1] and wide_frac in [top_frac, 1]")
        if self.top_n < 1:
            raise ValueError("top_n must be positive")
        for p in self.percentiles + self.ratio_percentiles:
            if not 0 < p <= 1:
                raise ValueError(f"percentile {p} outside (0, 1]")
        if not self.core_types:
            raise ValueError("core_types must not be empty")

    # year labels used in published column names, e.g. nc9619
    @property
    def y1(self) -> str:
        return str(self.min_year)[2:]

    @property
    def y2(self) -> str:
        return str(self.min_cite_year)[2:]

    @property
    def y3(self) -> str:
        return str(self.max_year)[2:]

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)

    def fingerprint(self, *names: str) -> str:
        """Stable hash of the named parameters, or of every parameter that changes a result."""
        d = asdict(self)
        d.pop("name", None)
        if names:
            d = {k: d[k] for k in names}
        return hashlib.sha256(json.dumps(d, sort_keys=True).encode()).hexdigest()[:16]


CAREER_2019 = Config(name="career", min_year=1960, min_cite_year=1996, max_year=2019)
SINGLE_YEAR_2019 = Config(name="single_year", min_year=1960, min_cite_year=2019, max_year=2019)
EDITION_2017 = Config(
    name="edition2017", min_year=1960, min_cite_year=1996, max_year=2017,
    edition="2017", min_classified=5, auid_floor=None,
)
