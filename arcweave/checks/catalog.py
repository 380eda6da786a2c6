"""Imports every query module so the registry is complete."""

from __future__ import annotations

from arcweave.checks.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    from arcweave.checks import q_geometry, q_model, q_results, q_runlog, q_validate  # noqa: F401
    return dict(REGISTRY)
