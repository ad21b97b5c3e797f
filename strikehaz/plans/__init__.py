"""Whole queries assembled from the operators."""

import importlib

MODULES = ["strike_queries", "monitoring_queries", "space_queries", "activity_queries", "metric_queries", "layer_queries", "model_queries", "source_queries"]


def all_queries():
    """Every registered plan by name."""
    from strikehaz.plans.registry import QUERIES

    for module in MODULES:
        importlib.import_module(f"strikehaz.plans.{module}")
    return dict(QUERIES)
