"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from . import answers, assess, build, corpus, guarding, judge, loading, retrieval, service, verifying

MODULES = (retrieval, corpus, answers, assess, judge, guarding, build, loading, verifying, service)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
