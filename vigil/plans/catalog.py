"""Imports every query module so that all keys are registered."""

from __future__ import annotations

import importlib

from vigil.plans.registry import REGISTRY, Entry

MODULES = ["vigil.plans.q_core", "vigil.plans.q_correlate", "vigil.plans.q_serve", "vigil.plans.q_ingest", "vigil.plans.q_train", "vigil.plans.q_features", "vigil.plans.q_io"]


def load_registry() -> dict[str, Entry]:
    for m in MODULES:
        importlib.import_module(m)
    return REGISTRY
