"""Equity-portfolio and time-series analytics on Spark, and operators for training-data pipelines.

The names below are found on first use, so workers load only what they run.
"""

from importlib import import_module

PUBLIC = {
    "Config": "tessera.plans.portfolio", "run": "tessera.plans.portfolio", "iterate": "tessera.plans.portfolio", "clusters": "tessera.plans.portfolio",
    "read_store": "tessera.sources.prices", "write_store": "tessera.sources.prices", "upsert": "tessera.sources.prices", "watchlist": "tessera.sources.prices", "calendar": "tessera.sources.prices",
    "simple_returns": "tessera.operators.windows", "log_returns": "tessera.operators.windows", "report": "tessera.operators.metrics", "composite": "tessera.operators.metrics",
    "normalize": "tessera.operators.weights", "stack": "tessera.operators.weights", "correlations": "tessera.operators.linalg", "shrunk": "tessera.operators.linalg",
}
__all__ = list(PUBLIC)


def __getattr__(name: str):
    if name not in PUBLIC:
        raise AttributeError(f"module {__name__} has no {name}")
    return getattr(import_module(PUBLIC[name]), name)
