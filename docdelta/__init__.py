"""Comparison of document versions at scale, on Spark DataFrames."""

from importlib import import_module

#: What users import from here, and where it lives; loaded when asked for.
_PUBLIC = {
    "Engine": "docdelta.plans.pipeline", "Comparison": "docdelta.plans.pipeline", "ComparisonResult": "docdelta.plans.pipeline",
    "ChatClient": "docdelta.plans.client", "ExtractionError": "docdelta.sources.layout", "read_layout": "docdelta.sources.layout", "from_texts": "docdelta.sources.layout",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module 'docdelta' has no attribute {name!r}")
    return getattr(import_module(_PUBLIC[name]), name)
