"""Registered queries by section."""

from __future__ import annotations

from importlib import import_module

SECTIONS = [
    "privacy",
    "retrieval",
    "partitioning",
    "tables",
    "analysis",
    "metrics",
    "streams",
]


def _load():
    for name in SECTIONS:
        import_module(f"quillmesh.plans.{name}")
    from quillmesh.plans import common

    return common


def registered():
    return dict(_load().QUERIES)


def checks():
    return dict(_load().ORACLE)
