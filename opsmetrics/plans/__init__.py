"""Registered queries: each operator run on the given tables, with its SQL counterpart."""

from importlib import import_module

MODULES = (
    "filters", "reports", "timelines", "catalogs", "alerting", "scans", "anomalies", "scalars", "streams",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
