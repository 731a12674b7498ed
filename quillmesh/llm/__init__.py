"""Operators of a training-data pipeline; nothing else in the library imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "url_filter", "bpe", "quality", "language_id", "packing", "fingerprints", "line_dedup", "jaccard_join",
    "suffix_dedup", "class_lm", "sum_squares", "merkle", "phrases",
]


def _load():
    for name in MODULES:
        import_module(f"quillmesh.llm.{name}")
    return import_module("quillmesh.llm.common")


def registered():
    return dict(_load().QUERIES)


def checks():
    return dict(_load().ORACLE)
