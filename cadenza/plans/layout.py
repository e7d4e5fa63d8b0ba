"""The item feature matrix of the experiments: 29 columns."""

from __future__ import annotations

#: Columns that are scaled, 0/1 columns, and values of the one-hot groups (fixed values).
CONTINUOUS = ["duration_ms", "danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo"]
BINARY = ["explicit", "mode"]
KEYS = list(range(12))
TIME_SIGNATURES = [3, 4, 5]


def layout() -> dict[str, tuple[list, str, str]]:
    """One-hot groups by column: values, prefix, and the name for null or anything else."""
    return {"key": (KEYS, "key", "unknown"), "time_signature": (TIME_SIGNATURES, "time_signature", "other")}
