"""All detectors, by name."""

from __future__ import annotations

from weftgraph.detectors import rules, shaped
from weftgraph.detectors.engine import REGISTRY, Detector, register


def all_detectors() -> dict[str, Detector]:
    if not REGISTRY:
        register(*rules.ALL, *shaped.ALL)
    return REGISTRY
