"""Every registered query, and the SQL it must agree with."""

from __future__ import annotations

import importlib

from cohortscale.catalog import base

MODULES = (
    "validation",
    "cohorts",
    "grids",
    "estimates",
    "reports",
    "selection",
    "reconciliation",
    "privacy",
    "logs",
    "files",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"cohortscale.catalog.{name}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(base.ORACLES)
