"""Queries over the given tables, one per operator, each with its SQL counterpart."""

import importlib

_MODULES = ["planning", "cleaning", "corpus", "evaluation", "reporting"]


def _load():
    from workload import registry

    for name in _MODULES:
        importlib.import_module(f"workload.{name}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().ORACLES)
