"""Queries bound to tables, and the batch jobs."""

from importlib import import_module

_MODULES = ("business_queries", "source_queries", "document_queries", "series_queries", "kpi_queries", "drift_queries", "forecast_queries", "ensemble_queries", "job_queries")


def all_queries():
    """The registry with every query module loaded."""
    for name in _MODULES:
        import_module(f"gaugeworks.plans.{name}")
    return import_module("gaugeworks.plans.registry")
