"""Queries over the shared tables."""

from __future__ import annotations

import importlib

PARTS = ("texts", "conversation", "log", "series", "gates", "streams")


def all_queries():
    """The registry with every part loaded."""
    for part in PARTS:
        importlib.import_module(f"sluiceway.plans.{part}")
    return importlib.import_module("sluiceway.plans.registry")
