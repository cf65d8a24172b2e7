"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from pairwright.catalogue.registry import QUERIES, TWINS

MODULES = (
    "identities",
    "references",
    "bindings",
    "splits",
    "sequences",
    "labels",
    "experiments",
    "trees",
    "scalars",
    "similarity",
    "scoring",
    "sessions",
)
for _module in MODULES:
    import_module(f"pairwright.catalogue.{_module}")

__all__ = ["QUERIES", "TWINS"]
