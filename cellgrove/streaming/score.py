"""Scoring of a stream of profiles: an extension; scaling and labels are plain expressions, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.clusters import Model
from ..operators.preprocess import Scaler


def score_stream(profiles: DataFrame, model: Model, scaler: Scaler | None = None, id_column: str = "CustomerID") -> DataFrame:
    """(id, cluster_id) of each row of a batch or streaming DataFrame of profiles (scaled already, if there is no scaler)."""
    rows = scaler.apply(profiles) if scaler else profiles
    return model.predict(rows).select(id_column, "cluster_id")
