"""The operators wired to the given tables, each with an equivalent DuckDB statement where SQL can say it."""

import importlib

_MODULES = ("sequences", "mining", "learning")


def _load():
    for name in _MODULES:
        importlib.import_module(f"tracemill.workload.{name}")
    return importlib.import_module("tracemill.workload.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
