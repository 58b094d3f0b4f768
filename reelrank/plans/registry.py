"""All queries outside reelrank.llm, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from reelrank.plans import catalogue, files, judging, more_sql, people, records, texts

_MODULES = [records, catalogue, people, files, texts, judging]


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in [*_MODULES, more_sql] for k, s in m.ORACLE.items()}


def flagship() -> Callable:
    return people.title_search_flagship
