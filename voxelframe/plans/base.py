"""Registration of queries with the SQL that each is held against."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers the function under its name; without SQL it is tested by brute force."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
