"""Where query modules register: name -> query, and name -> its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
