"""Query plans: derived relations and the registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
