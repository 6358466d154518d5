"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable


def catalog() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, twins, decorator) of one module. The decorator takes the twin (None without one) and
    refuses a name that the module has already."""
    queries: dict[str, Callable] = {}
    twins: dict[str, str] = {}

    def query(sql: str | None) -> Callable:
        def add(f: Callable) -> Callable:
            if f.__name__ in queries:
                raise ValueError(f"query {f.__name__} is registered twice")
            queries[f.__name__] = f
            if sql is not None:
                twins[f.__name__] = sql
            return f

        return add

    return queries, twins, query
