"""Import every catalog module so its entries register, then expose them."""

from __future__ import annotations

import importlib

from cohort.plans.common import QUERIES, ORACLES

_MODULES = ["kpi_queries", "insight_queries", "misc_queries", "profile_queries", "explore_queries", "clean_queries", "metric_queries", "model_queries", "segment_queries", "score_queries", "record_queries", "intake_queries", "stream_queries"]


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(f"cohort.plans.{m}")
        except ModuleNotFoundError as e:  # a module not written yet
            if f"cohort.plans.{m}" not in str(e):
                raise


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
