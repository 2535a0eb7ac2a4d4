"""All registered queries with their SQL, by name."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("catalog_form", "catalog_scores", "catalog_ratings", "catalog_live", "catalog_board", "catalog_sources", "catalog_models", "catalog_slices", "catalog_streams", "catalog_boost", "catalog_stored", "catalog_wired")


def registered() -> dict[str, tuple]:
    """``name -> (callable(spark, folder), sql or None)``."""
    out: dict[str, tuple] = {}
    for part in _PARTS:
        for name, entry in import_module(f"{__package__}.{part}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = entry
    return out
