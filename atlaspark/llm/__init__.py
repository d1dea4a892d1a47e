"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import importlib

_NAMES = ["split", "neardup", "spectral", "neighbours", "packing", "mixing", "subjects"]


def query_modules() -> list:
    """The modules that register queries, in the order of their problems."""
    return [importlib.import_module(f"atlaspark.llm.{m}") for m in _NAMES]
