"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from kiloqueue.plans.registry import ORACLES, QUERIES

MODULES = [
    "kiloqueue.plans.queue_queries",
    "kiloqueue.plans.prep_queries",
    "kiloqueue.plans.serve_queries",
    "kiloqueue.plans.summary_queries",
    "kiloqueue.plans.ts_queries",
    "kiloqueue.plans.stream_queries",
    "kiloqueue.plans.io_ml_queries",
    "kiloqueue.plans.label_queries",
    "kiloqueue.plans.pipeline_queries",
]

for _m in MODULES:
    importlib.import_module(_m)

__all__ = ["QUERIES", "ORACLES"]
