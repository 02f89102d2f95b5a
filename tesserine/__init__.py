"""A Spark-native text-corpus engine."""

import importlib

__all__ = ["Tree", "count_tokens", "pack", "scan", "scan_security"]


def __getattr__(name: str):
    """The verbs, imported when asked for: workers that need one operator don't load all."""
    if name in __all__:
        return getattr(importlib.import_module(".api", __name__), name)
    raise AttributeError(name)
