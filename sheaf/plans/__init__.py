"""Named queries over the given tables."""

import importlib

_MODULES = ("retrieval", "web", "documents", "serp", "semistructured", "store", "bookkeeping", "memory", "conversations", "streams")


def _load():
    for m in _MODULES:
        importlib.import_module(f".{m}", __name__)
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES


def queries():
    return dict(_load()[0])


def oracle_sql():
    return dict(_load()[1])
