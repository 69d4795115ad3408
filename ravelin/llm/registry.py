"""Collects the named queries of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["q_code", "q_text", "q_corpus"]


def _modules():
    return [importlib.import_module(f"ravelin.llm.{m}") for m in MODULES]


def queries():
    return {k: f for m in _modules() for k, f in m.queries().items()}


def oracle():
    return {k: q for m in _modules() for k, q in m.oracle().items()}
