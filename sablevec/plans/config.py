"""Build and search parameters."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class Config:
    """``pruning``: fixed or global; ``blocking``: chunks, round_robin, representatives; ``metric``: max or centroid;
    ``transform``: identity or jlt; ``summary_components`` instead of an energy makes summaries of a fixed size."""

    n_postings: int = 3500
    pruning: str = "fixed"
    max_fraction: float = 1.5
    blocking: str = "chunks"
    block_size: int = 10
    centroid_fraction: float = 0.1
    representatives: int = 400
    doc_cut: int | None = 15
    metric: str = "max"
    summary_energy: float = 0.4
    summary_components: int | None = None
    quantised: bool = False
    transform: str = "identity"
    jlt_rows: int = 256
    jlt_nonzeros: int = 8
    nknn: int = 0
    seed: int = 7

    def __post_init__(self):
        for name, allowed in (("pruning", ("fixed", "global")), ("blocking", ("chunks", "round_robin", "representatives")), ("metric", ("max", "centroid")), ("transform", ("identity", "jlt"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


@dataclasses.dataclass(frozen=True)
class Search:
    """``cut``: lists of a query; ``heap_factor`` 0 keeps every block; ``alpha`` over 0 uses radii, else ``by_count`` may; ``n_knn``: neighbours to add."""

    k: int = 10
    cut: int = 10
    heap_factor: float = 0.7
    alpha: float = 0.0
    by_count: bool = False
    n_knn: int = 0


def index_name(base: str, **params) -> str:
    """A file name that holds its parameters in sorted order."""
    return "_".join([base, *(f"{k}_{v}" for k, v in sorted(params.items()))])
