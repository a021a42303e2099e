"""All queries of the reconciliation engine and their SQL twins, by name."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); `sql` gives the same rows in DuckDB."""

    def keep(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from tidemark.plans import content_queries, guard_queries, path_queries, reconcile_queries, store_queries, stream_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
