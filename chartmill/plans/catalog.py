"""Registry of named queries and their ANSI check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartmill.plans.roles import Tables, with_roles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}
_BODIES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional check."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if check is not None:
            _BODIES[name] = check
            _CHECKS[name] = with_roles(check)
        return fn

    return wrap


def check_body(name: str) -> str:
    """Check query of a registered name without its role definitions, for use in another one."""
    return _BODIES[name]


def load_all() -> tuple[dict, dict]:
    from chartmill.plans import (  # noqa: F401
        queries_scalar,
        queries_metrics,
        queries_trends,
        queries_search,
        queries_link,
        queries_quality,
        queries_dedup,
        queries_merge,
        queries_text,
        queries_convert,
        queries_report,
        queries_capture,
        queries_stream,
    )

    return dict(_QUERIES), dict(_CHECKS)
