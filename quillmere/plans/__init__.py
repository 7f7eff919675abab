"""Registered queries, one module per family of operators."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every query module, so that it registers its queries."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        import_module(f"{__name__}.{module}")
