"""All registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

_PARTS = ("velocity", "quality", "label", "rule", "evaluation", "monitoring", "model", "stream", "sketch")


def _collect(what: str) -> dict:
    out: dict = {}
    for part in _PARTS:
        module = importlib.import_module(f"riskweave.plans.{part}_queries")
        out.update(getattr(module, what))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict[str, str]:
    return _collect("ORACLE")
