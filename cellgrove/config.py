"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass

#: The profile's features in contract order.
FEATURES = (
    "recency",
    "frequency",
    "monetary",
    "avg_basket",
    "product_diversity",
    "return_rate",
    "weekend_ratio",
    "repeat_category_rate",
)
#: The features that are log-transformed.
LOG_FEATURES = FEATURES[:5]
NOISE = -1


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: parameters, grids and limits, as far as numbers are given
    seed: int = 42
    xi: int = 8
    tau: float = 0.05
    xi_grid: tuple[int, ...] = (8, 10, 12)
    tau_grid: tuple[float, ...] = (0.10, 0.12, 0.14, 0.16, 0.18)
    min_clusters: int = 4
    max_clusters: int = 10
    min_coverage: float = 0.85
    min_frequency: int = 2
    winsor_quantiles: tuple[float, float] = (0.01, 0.99)
    winsor_on: str = "all"
    test_share: float = 0.2
    country: str | None = None
    #: Where transactions are looked for if no path is given.
    transactions: str = "data/transactions.csv"
    #: Rows from which silhouettes are made, larger inputs being sampled by a hash of the id; None: all rows.
    silhouette_rows: int | None = None
    #: Rows that the pipeline's agglomerative clustering takes at most, as its time grows with their square; None: all.
    agglomerative_rows: int | None = None

    def __post_init__(self):
        if self.winsor_on not in ("all", "train"):
            raise ValueError("winsor_on is 'all' or 'train'")
        check_parameters(self.xi, self.tau)


def check_parameters(xi: int, tau: float) -> None:
    if xi < 2:
        raise ValueError("xi must be at least 2")
    if not 0 < tau < 1:
        raise ValueError("tau must lie between 0 and 1")
